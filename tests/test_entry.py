import importlib
import sys

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
FAST = ("drug_mentions", "dose_pairs", "negation_positions", "entity_flags", "wer_by_provider", "headline", "significance", "findings_by_kind", "accent_tiers", "stratified_draw", "quota_checks", "duplicate_pairings", "speech_rate_outliers", "lexicon_build", "pending_clips", "spend_cap", "run_summary", "member_key_join", "secret_scan", "case_scores", "case_findings", "normalised_texts", "marked_texts", "wer_conversations", "cache_round_trip", "manifest_round_trip", "reported_payloads", "scores_sanity", "taxonomy_summary", "speaker_bootstrap")


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and rows[0].clips > 0


def rows_of(table):
    clean = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(clean(v) for v in r) for r in table[sorted(table.columns)].astype(object).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_its_sql(spark, sf_dir, tables, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), tables.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_sheet_coverage_goes_through_its_line_items_once(spark, sf_dir, tables, monkeypatch):
    from tessalith.plans import fixture

    read, plain = [], fixture.table
    monkeypatch.setattr(fixture, "table", lambda spark, sf_dir, name: read.append(name) or plain(spark, sf_dir, name))
    out = entry.queries()["sheet_coverage"](spark, sf_dir)
    assert read.count("lineitem") == 1 and not [f for f in out.inputFiles() if "lineitem" in f]
    assert rows_of(out.toPandas()) == rows_of(tables.execute(entry.oracle_sql()["sheet_coverage"]).df())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", ["tessalith.llm", "zstandard", "public_tokenizers"])
def test_other_queries_stay_without_the_subpackage(monkeypatch, gone):
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(gone) or (gone == "tessalith.llm" and name == "corpus_pipeline"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.delitem(sys.modules, gone, raising=False)

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tessalith.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    fresh = importlib.reload(entry)
    names = set(fresh.queries())
    assert "headline" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
