"""Relational operators: scoring, summaries, tests, findings, sampling, lexicon, integrity, ingest."""
