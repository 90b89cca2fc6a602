import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessalith import sinks
from tessalith.operators import integrity as it
from tessalith.operators import scoring as sc
from tessalith.schemas import CACHE, MANIFEST
from tessalith.sources import audio as au
from tessalith.sources import tables as tb
from tessalith.streaming import scores as st


def tone(seconds, rate=16_000, loud=0.2, hertz=220):
    return loud * np.sin(2 * np.pi * hertz * np.arange(int(seconds * rate)) / rate)


def test_manifest_round_trip(spark, tmp_path):
    row = ("c1", "test", "yoruba", "A", "clinical", 4.5, 'says "no", twice\nnew line', True, "a|b", False, "", True, True, "f", "20-30", "NG", "s1", "/x/y.wav")
    df = spark.createDataFrame([row], MANIFEST)
    sinks.write_csv(df, str(tmp_path / "m"))
    assert [tuple(r) for r in tb.read_manifest(spark, str(tmp_path / "m")).fillna("").collect()] == [row]


def test_first_split_with_transcripts(spark):
    frames = {"dev": [("", 1), (" ", 2)], "train": [("said", 1), (" ", 2)]}
    name, frame = tb.choose_split(lambda s: spark.createDataFrame(frames[s], "transcript string, n int"))
    assert name == "train" and frame.count() == 1
    with pytest.raises(RuntimeError, match="test: KeyError.*dev: all transcripts are empty"):
        tb.choose_split(lambda s: spark.createDataFrame({"dev": frames["dev"]}[s], "transcript string, n int"), ("test", "dev"))


def test_cache_scan_and_store(spark, tmp_path):
    store = sinks.store_json(str(tmp_path))
    for p in ("p1", "p2", "_old"):
        store({"clip_id": "c1", "provider": p, "model": "m", "text": f"by {p}", "latency_ms": None, "audio_seconds": 1.0, "cost_usd": 0.0})
    assert sorted(r.text for r in tb.read_cache(spark, str(tmp_path)).collect()) == ["by p1", "by p2"]
    assert tb.cached_path("root", "p", "c") == "root/p/c.json"
    assert tb.read_cache(spark, str(tmp_path / "none")).count() == 0
    sinks.append_cache(tb.read_cache(spark, str(tmp_path)), str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).filter("provider = 'p1'").count() == 1


def test_word_lists(spark, tmp_path):
    (tmp_path / "names").write_text("# note\nQuinine\n\n artemether \n  # more\nquinine\n")
    assert sorted(r.term for r in tb.read_names(spark, str(tmp_path / "names")).collect()) == ["artemether", "quinine"]
    assert tb.read_words(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        tb.read_lexicon(spark, str(tmp_path / "none"))
    sinks.write_lexicon(spark.createDataFrame([("b",), ("a",), ("b",)], "term string"), str(tmp_path / "lex"))
    assert "".join(p.read_text() for p in (tmp_path / "lex").glob("part*")) == "a\nb\n"
    assert sorted(r.term for r in tb.read_lexicon(spark, str(tmp_path / "lex")).collect()) == ["a", "b"]
    (tmp_path / "records").write_text(json.dumps({"generic_name": "x", "active_ingredients": [{"name": "y"}]}) + "\n{}\n")
    assert tb.read_drug_records(spark, str(tmp_path / "records")).count() == 2


def test_paged_service():
    pages = {0: (200, [1, 2]), 2: (200, [3]), 4: (404, [])}
    assert tb.fetch_pages(lambda skip, n: pages[skip], page=2, most=10) == [1, 2, 3]

    def failing(skip, n):
        if skip:
            raise OSError
        return 200, [1]

    assert tb.fetch_pages(failing, page=1, most=5) == [1]
    with pytest.raises(RuntimeError):
        tb.fetch_pages(lambda s, n: (200, []))


def test_archives(spark, tmp_path):
    def archive(name, members):
        with tarfile.open(tmp_path / name, "w:gz") as f:
            for path, samples in members.items():
                data = samples if isinstance(samples, bytes) else au.wav_bytes(samples)
                info = tarfile.TarInfo(path)
                info.size = len(data)
                f.addfile(info, io.BytesIO(data))

    archive("test_yoruba_0.tar.gz", {"data/intron/s1/bad.wav": b"RIFF no sound", "data/intron/s1/a.wav": tone(1), "data/intron/s2/a.wav": tone(2), "data/intron/s3/b.wav": tone(1)})
    (tmp_path / "test_igbo_0.tar.gz").write_bytes(b"not an archive")
    rows = [("c1", "test", "yoruba", "/set/test/s1/a"), ("c2", "test", "yoruba", "/set/test/s2/a.wav"), ("c3", "test", "yoruba", "/set/test/s9/zz.wav"), ("c4", "test", "igbo", "/set/test/s1/a.wav"), ("c5", "test", "yoruba", "/set/test/s1/bad.wav")]
    manifest = spark.createDataFrame(rows, "clip_id string, split string, accent string, path string")
    archives = spark.read.format("binaryFile").load(str(tmp_path / "*.tar.gz"))
    assert au.total_bytes(archives) > 0
    with pytest.raises(ValueError):
        au.total_bytes(archives, 10)
    streamed = au.extract(archives.select("path"), manifest).collect()
    out = au.extract(archives, manifest).collect()
    assert sorted(map(str, out)) == sorted(map(str, streamed))
    assert {r.clip_id: len(au.samples_of(bytes(r.content))[0]) for r in out if r.content is not None} == {"c1": 16_000, "c2": 32_000}
    assert {(r.clip_id, r.error.split(":")[0]) for r in out if r.error} == {("c3", "not in the archive"), (None, "ReadError"), ("c4", "ReadError"), ("c5", "Error")}
    sinks.write_wavs(spark.createDataFrame([(r.clip_id, r.content) for r in out if r.content is not None], "clip_id string, content binary"), str(tmp_path / "wav"))
    assert sorted(r.clip_id for r in au.missing_audio(manifest, au.read_audio(spark, str(tmp_path / "wav"))).collect()) == ["c3", "c4", "c5"]
    measured = {r.clip_id: r for r in au.measure(au.read_audio(spark, str(tmp_path / "wav"))).collect()}
    assert measured["c2"].seconds == 2 and measured["c1"].rms == pytest.approx(0.2 / 2**0.5, rel=0.01)
    assert [tuple(r) for r in tb.needed_archives(manifest).collect()] == [("igbo", "test"), ("yoruba", "test")]
    assert tb.archive_address("base", "igbo", "test") == "base/audio/igbo/test/test_igbo_0.tar.gz"


def test_measuring_odd_files(spark):
    rows = [("x/a.wav", au.wav_bytes(np.zeros(0))), ("x/b.wav", b"RIFF"), ("x/c.wav", au.wav_bytes(np.zeros(100)))]
    out = {r.clip_id: r for r in au.measure(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert out["a"].seconds == 0 and out["a"].rms == 0 and out["b"].error and out["c"].rms == 0


def test_resampling_keeps_the_tone():
    stereo = np.stack([tone(1, 44_100), tone(1, 44_100)], axis=1)
    mono = au.to_mono(stereo, 44_100)
    assert len(mono) == 16_000 and mono.dtype == np.float32
    assert abs(int(np.abs(np.fft.rfft(mono)).argmax()) - 220) <= 1
    high = au.to_mono(tone(1, 44_100, hertz=12_000), 44_100)
    assert np.sqrt(np.mean(high[200:-200] ** 2)) < 0.01
    assert len(au.to_mono(tone(0.5), 16_000)) == 8000


def test_pages_and_report(spark):
    row = (1, "detector", "c<1>", "p", "x", "A", "clinical", "DRUG-SUB", "a&b", "c", 1.0, "r [[x]]", "h", "DRUG-SUB candidate", "", "", "", "")
    schema = ", ".join(f"{c} {'int' if c == 'finding_id' else 'double' if c == 'weight' else 'string'}" for c in sc.SHEET)
    sheet = spark.createDataFrame([row], schema)
    page = sinks.review_page(sc.cards(sheet))
    assert "c&lt;1&gt;" in page and "a&amp;b" in page and "NO-ERROR" in page
    clip = spark.createDataFrame([("c1", "said <this>", "s", "p", 1.0)], "clip_id string, transcript string, speaker_id string, path string, duration double")
    assert "said &lt;this&gt;" in sinks.listen_page(clip, [("c1", ["too <fast>"])])
    report = sinks.integrity_report({"halt": True, "checked": 1, "flagged": 1, "suspicious": 0, "expected": 0, "findings": [("c1", ["why"])]}, it.duplicate_pairings(clip))
    assert "**Outcome: HALT**" in report and "`c1`: why" in report and "None." in report
    assert all(k in sinks.instructions() for k in sinks.CODES)
    assert set(k for k in ("DRUG-SUB", "DRUG-DEL", "DOSE-VAL", "DOSE-UNIT", "DOSE-MISS", "NEG-FLIP", "ASR-COLLAPSE")) <= set(sinks.CODES)


def test_streaming_scores_each_answer_once(spark, tmp_path):
    store = sinks.store_json(str(tmp_path / "cache"))
    manifest = spark.createDataFrame([(f"c{k}", "x", "A", "clinical", 1.0, "takes warfarin") for k in range(3)], "clip_id string, accent string, tier string, domain string, duration double, transcript string")
    lexicon = spark.createDataFrame([("warfarin",)], "term string")
    out = str(tmp_path / "out")
    for clips in (("c0", "c1"), ("c2",)):
        for c in clips:
            store({"clip_id": c, "provider": "p", "model": "m", "text": "takes warfarin", "latency_ms": 1.0, "audio_seconds": 1.0, "cost_usd": 0.0})
        q = st.score_stream(st.stream_cache(spark, str(tmp_path / "cache")), manifest, lexicon, lambda df: df.write.mode("append").parquet(out), str(tmp_path / "check"))
        q.awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == 3 and rows.agg(F.sum("drug_correct")).first()[0] == 3
    assert CACHE.fieldNames()[0] == "clip_id"


def test_a_page_is_never_cut(spark, monkeypatch):
    monkeypatch.setattr(sinks, "PAGE_ROWS", 2)
    rows = spark.range(3)
    with pytest.raises(ValueError, match="more than 2 rows"):
        sinks.page_rows(rows)
    assert len(sinks.page_rows(spark.range(2))) == 2


def test_a_built_lexicon_is_read_again(spark, tmp_path):
    terms = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    path, asked = str(tmp_path / "lexicon"), []

    def make():
        asked.append(1)
        return terms("aspirin", "morphine")

    def down():
        raise ConnectionError("no line")

    read = lambda *a, **k: sorted(r.term for r in sinks.built_lexicon(spark, path, *a, **k).collect())
    assert read(make) == read(make) == ["aspirin", "morphine"] and len(asked) == 1
    assert read(down, terms("codeine"), force=True) == ["codeine"]
    with pytest.raises(ConnectionError):
        sinks.built_lexicon(spark, path, down, force=True)


def test_a_paged_service_is_read_page_by_page(spark):
    from tessalith.sources import paged

    records = paged.read_records(spark, "tests.paged_service:call", page=2, most=12)
    assert records.count() == 7 and records.rdd.getNumPartitions() == 6
    assert paged.read_records(spark, "tests.paged_service:flaky", page=2, most=12).count() == 5
    generic, brand = paged.generic_and_brand_only(records)
    assert {r.term for r in generic.collect()} == {"salt", *(f"drug{k}" for k in range(7))} and [r.term for r in brand.collect()] == ["brand"]
    with pytest.raises(Exception, match="no record"):
        paged.read_records(spark, "tests.paged_service:empty", page=2, most=4).count()
