import math
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from tessalith.llm import fertility

PIECE, MULTI = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SENTENCE = "the quick brown fox jumps over a lazy dog near the old river bank while seven small birds sing in green trees"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


ROWS = [
    (0, SENTENCE, "en", None), (1, None, "en", None), (2, "", None, None), (3, " \n\t\n", "xx", None),
    (4, f"{SENTENCE}\n{SENTENCE}\n  \n{SENTENCE}", "en", None), (5, "a b c d e f g h " * 3 + SENTENCE, "en", None),
    (6, "***# | <x> & é日本 " * 30, "en", None), (7, "日本語の文章を読みます " * 3, "ja", None), (8, "word " * 3000, None, None),
    (4, SENTENCE, "en", None), (9, "x" * 50_000, None, None), (10, "one\n one\none\n\n\none ", "en", None),
]


def test_counts_match_brute_force(documents):
    rows = fertility.judge(documents(ROWS), PIECE, MULTI).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((i, *brute(t)) for i, t, *_ in ROWS)


def test_measures_are_the_tokenizers_own(documents):
    own = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for r in fertility.judge(documents(ROWS), PIECE, MULTI).collect():
        if r.doc_id in (0, 6, 7, 9):
            text = next(t for i, t, *_ in ROWS if i == r.doc_id)
            ids = [x for w in text.split() for x in own.encode(w)]
            bits = -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values())
            assert r.chars_per_token == pytest.approx(r.word_chars / len(ids))
            assert r.fallback_share == pytest.approx(sum(map(own.is_byte, ids)) / len(ids))
            assert r.entropy == pytest.approx(bits / math.log2(len(ids)))


def test_bands_and_scripts(documents):
    rows = {r.doc_id: r for r in fertility.judge(documents([r for r in ROWS if r[0] != 4]), PIECE, MULTI).collect()}
    assert rows[0].kept and rows[0].script == "latin"
    assert rows[1].script is None and not rows[1].kept and rows[1].chars_per_token is None
    assert rows[7].script in ("han", "kana")
    strict = {"en": fertility.Band((50.0, 60.0), (0.0, 60.0))}
    assert not fertility.judge(documents(ROWS[:1]), PIECE, MULTI, bands=strict).first().kept
    assert fertility.judge(documents(ROWS[:1]), PIECE, MULTI, lang_col=None).first().kept


def test_empty_table(documents):
    assert fertility.judge(documents([]), PIECE, MULTI).count() == 0


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = fertility.judge(docs, PIECE, MULTI).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg({"kept": "count"}).count()
    rows = fertility.judge(docs, PIECE, MULTI).join(labels, "doc_id").filter("not base_failed").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    assert kept == 2 and sum(clean) >= 0.99 * len(clean)
