import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_mixing import brute_targets, size
from tests.llm.test_set_join import brute as brute_groups

WORDS = "the of and river house garden morning people town slowly bright water under tree walk song light stone window friend".split()


def make(tmp_path_factory, spark):
    rng, rows, labels = random.Random(9), [], []
    bench = [" ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(25)) for _ in range(3)]
    for k in range(300):
        junk = k % 5 == 0
        text = "BUY!! NOW!! *** $$$ " * 12 + str(k) if junk else " ".join(rng.choice(WORDS) + rng.choice(["", "", f"{k}x{rng.randrange(30)}"]) for _ in range(rng.randint(30, 90)))
        if k % 17 == 1:
            text += " " + bench[k % 3] + " " + rng.choice(WORDS)
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
        if k % 2 == 0:
            labels.append((k, int(not junk), 0))
    rows += [(400 + k, rows[3 * k + 1][1] + " end", "en", "s1", 9) for k in range(12)] + [(500, rows[7][1], "en", None, 9), (7, rows[7][1], "en", "s3", len(rows[7][1]))]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, bench


@pytest.fixture(scope="module")
def stages(tmp_path_factory, spark):
    """What each stage returns, on what the one before returned."""
    folder, rows, bench = make(tmp_path_factory, spark)
    outs, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        outs.append(docs.collect())
    return folder, rows, bench, outs


def test_stage_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    for out in stages[3][:4]:
        assert out[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_clean_documents(stages):
    _, rows, _, (kept, *_) = stages
    clean = sorted((i, t) for i, t, *_ in rows if "BUY" not in t)
    assert sorted((r.doc_id, r.text) for r in kept) == clean


def test_one_of_each_group_stays(stages):
    _, _, _, (before, after, *_) = stages
    groups = brute_groups([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in groups})


def test_contaminated_documents_go(stages):
    _, _, bench, (_, before, after, *_) = stages
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not any(b in r.text for b in bench))


def test_mix_takes_its_targets(stages):
    _, _, _, (_, _, before, after, _) = stages
    sizes = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    targets, texts = brute_targets(sizes), {r.doc_id: r.text for r in before}
    for s in sizes:
        assert sum(size(r.text) for r in after if r.source == s) == int(targets[s] + 1e-9)
    assert all(texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in after)
    assert max(sum(r.doc_id == i for r in after) for i in texts) <= 3


def test_token_files_are_in_training_order(stages, spark):
    folder, _, _, outs = stages
    before = spark.read.parquet(f"{folder}/out2")
    order = cp.mixing.curriculum(before).collect()  # sorted by position
    after = sorted(outs[4], key=lambda r: r.start)
    assert [r.doc_id for r in after] == [r.doc_id for r in order] != sorted(r.doc_id for r in order)
    lengths = [len(r.text) for r in order]
    assert len(after) == len(lengths) and after[0].start == 0


def test_empty_tables_nulls_and_clashing_names(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __score double, __key string, __out0 long, size int"
    some = [(k, f"words of text number {k} " * 4, "en", None, 9, 0.5, "k", 1, 2) for k in range(4)] + [(None, None, None, None, None, None, None, None, None)]
    for name, rows in (("empty", []), ("odd", some)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = cp.run(spark, folder).collect()
        assert (len(got) > 0) == bool(rows) and {r.doc_id for r in got} <= {None, 0, 1, 2, 3}


def test_ids_are_those_of_the_copies_and_run_agrees(stages, spark):
    folder, _, _, (*_, before, after) = stages
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, len(ids := [*t.encode(r.text, add_special_tokens=False).ids, 0]), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in before)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in after) == want
    again = cp.run(spark, folder).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in again) == sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in after)


def test_rows_without_an_id_or_with_anothers_are_judged_by_their_text(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(f"{rng.choice(WORDS)}{rng.randrange(900)}" for _ in range(60)) for _ in range(8)]
    item = " ".join(f"{rng.choice(WORDS)}{rng.randrange(900)}" for _ in range(25))
    rows = [(1, texts[0]), (None, texts[0] + " end"), (None, texts[1]), (None, texts[1] + " end"), (None, texts[1]), (2, texts[2]), (2, texts[3]), (3, texts[3] + " end"), (None, texts[4]), (None, None), (None, None), (4, ""), (4, "")]
    got = [tuple(r) for r in cp.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(i for i, _ in got if i is not None) == [1, 2, 2, 4] and {t for i, t in got if i == 2} == {texts[2], texts[3]}
    assert sorted((t or "")[:20] for i, t in got if i is None) == sorted(["", "", texts[1][:20], texts[4][:20]])
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{texts[5]} {item} x"), (None, texts[5]), (5, f"{texts[6]} {item}"), (5, texts[7])]
    got = cp.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(r.text for r in got) == sorted([texts[5], texts[7]])
