import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessalith.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def plain(added=True):
    """The untouched library, or with literals of added tokens as text."""
    t = Tokenizer.from_file(PATH)
    if not added:
        t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def tokenizer():
    return plain()


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab.,ßd \n\té1!'s\x85\xa0 \x1c日", "<|endoftext|>", "<|endof"]), max_size=30).map("".join), max_size=8), st.booleans())
def test_pieces_give_the_ids_of_the_whole_text(texts, added):
    got = [x.tolist() for x in tf.encoder(PATH, added).encode(pa.array(texts, pa.string()))]
    assert got == [[*plain(added).encode(x, add_special_tokens=False).ids, 0] for x in texts]


def check(rows, result, tokenizer):
    result = sorted(result, key=lambda r: r.start)
    wanted = sorted(((i, whole(tokenizer, t)) for i, t in rows), key=lambda x: x[0])
    assert [r.doc_id for r in result] == [i for i, _ in wanted]
    start, by_id = 0, {}
    for i, ids in wanted:
        by_id.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in result:
        assert r.start == start
        start += r.n_tokens
        by_id[r.doc_id].remove((r.n_tokens, r.ids_crc32))


def test_round_trip_with_odd_rows(spark, documents, tokenizer):
    rows = [(7, "One two."), (3, None), (5, ""), (9, " \n\t x  y "), (3, "again"), (3, "again"), (-2, "long " * 20_000), (11, "<|endoftext|> é日"), *((100 + k, f"number {k} of many words") for k in range(300))]
    result = tf.round_trip(documents(rows), PATH).collect()
    check(rows, result, tokenizer)


@pytest.mark.parametrize("repeated", ["same id", "same row", "no id"])
def test_a_hot_id_is_cut_into_ranges(spark, documents, tokenizer, monkeypatch, repeated):
    monkeypatch.setattr(tf, "SHARD_INPUT", 1000)
    text = lambda k: "one text" if repeated == "same row" else f"text number {k}"
    rows = [(None if repeated == "no id" else 5, text(k)) for k in range(400)] + [(k, f"other {k}") for k in range(10, 200)]
    result = tf.round_trip(documents(rows), PATH).collect()
    if repeated != "no id":
        check(rows, result, tokenizer)
    of_hot = [r.shard for r in result if r.doc_id in (None, 5)]
    assert len(of_hot) == 400 and len(set(of_hot)) > 3 and max(map(of_hot.count, set(of_hot))) < 200


def test_another_order(documents, tokenizer):
    from pyspark.sql import functions as F

    rows = [(k, f"text {k}") for k in range(50)]
    result = sorted(tf.round_trip(documents(rows), PATH, order=-F.col("doc_id")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in result] == list(range(49, -1, -1)) and all(r.n_tokens == len(whole(tokenizer, f"text {r.doc_id}")) for r in result)


def test_empty_table(documents, spark):
    assert tf.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_single_document_access_and_rolls(spark, documents, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "SHARD_BYTES", 200)
    folder = f"file://{tmp_path}"
    rows = [(k, f"text {k} " * (k % 7)) for k in range(60)]
    manifest = tf.write_token_files(documents(rows), PATH, folder).collect()
    assert sum(m.n_docs for m in manifest) == 60
    found = {}
    for m in manifest:
        shard = tf.Shard(folder, m.shard)
        for k, text in rows:
            if (at := shard.find(k)) >= 0:
                found[k] = shard.ids(at).tolist()
        shard.close()
    assert found == {k: whole(tokenizer, t) for k, t in rows}


def test_another_dictionary_is_refused(documents, tmp_path):
    folder = f"file://{tmp_path}"
    (m, *_) = tf.write_token_files(documents(["a b c"]), PATH, folder).collect()
    (tmp_path / "dictionary.zdict").write_bytes(b"other")
    with pytest.raises(ValueError):
        tf.Shard(folder, m.shard)


def test_queries_give_the_ids_of_the_untouched_library(spark, documents, tmp_path):
    import corpus_pipeline
    from tessalith.llm.queries import QUERIES

    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "x<|endoftext|>y."), (4, "no literal <|endoftext |>"), (5, None), (6, "plain words here")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    check(rows, QUERIES["op8_token_ids"](spark, str(tmp_path)).collect(), plain())
    check(rows, corpus_pipeline.token_ids(spark, documents(rows), str(tmp_path)).collect(), plain())
