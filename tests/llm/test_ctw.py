import re
from collections import Counter, defaultdict
from functools import cache
from math import exp, lgamma, log, log10
from zlib import crc32

import numpy as np
import pytest

from vitalstream.llm import ctw


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def string_of(text):
    return b"\n" * ctw.DEPTH + b"".join(w + b" " for w in words_of(text)) + b"\n"


def brute(train):
    """Scores a text by the definition: a dictionary of contexts, weights by recursion from the longest."""
    n = defaultdict(lambda: [0, 0])
    longer = defaultdict(set)
    for text in train:
        s = string_of(text)
        for i in range(ctw.DEPTH, len(s)):
            for k in range(8):
                node, bit = (1 << k) | (s[i] >> (8 - k)), s[i] >> (7 - k) & 1
                for d in range(ctw.DEPTH + 1):
                    n[s[i - d : i], node][bit] += 1
                    if d < ctw.DEPTH:
                        longer[s[i - d : i], node].add(s[i - d - 1 : i])

    def own(c, node):
        a, b = n[c, node]
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(np.pi)

    @cache
    def weighted(c, node):
        if len(c) == ctw.DEPTH:
            return own(c, node)
        return np.logaddexp(log(0.5) + own(c, node), log(0.5) + sum(weighted(x, node) for x in longer[c, node]))

    def score(text):
        s, total = string_of(text), 0.0
        for i in range(ctw.DEPTH, len(s)):
            for k in range(8):
                node, bit = (1 << k) | (s[i] >> (8 - k)), s[i] >> (7 - k) & 1
                p, rest, last = 0.0, 1.0, 0.5
                for d in range(ctw.DEPTH + 1):
                    c = s[i - d : i]
                    if (c, node) not in n:
                        break
                    a = n[c, node]
                    last = (a[bit] + 0.5) / (sum(a) + 1)
                    stop = 1.0 if d == ctw.DEPTH else exp(log(0.5) + own(c, node) - weighted(c, node))
                    p, rest = p + rest * stop * last, rest * (1 - stop)
                total += log10(p + rest * last)
        return total

    return score


TEXTS = ["the cat sat on the mat", "The CAT\tsat  on\n the hat", "", None, "a", "naïve été É", "zzzz zzzz zzzz", "the cat sat on the mat"] * 4 + ["q" * 300, "the hat sat on a cat"]


def test_matches_the_definition(documents):
    rows = [(i, t, "en", None) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], None, "a")]
    held = lambda i: crc32(str(i).encode()) % 10 == 0
    train = [r[1] for r in rows if not held(r[0])]
    counts = Counter(w for t in train for w in [*words_of(t), None])
    total, distinct = sum(counts.values()), len(counts)
    score = brute(train)
    got = ctw.score(documents(rows), block_chars=200).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r.doc_id]
        listed = [*words_of(text), None]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(listed), total)
        assert r.n_known == sum(counts[w] > 0 for w in listed)
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in listed), rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(score(text), rel=1e-6)
        assert r.bits_per_byte == pytest.approx(-r.score / log10(2) / (len(string_of(text)) - ctw.DEPTH))


def test_many_equal_rows(spark):
    """Rows of one id and text beyond what a block can number: each is scored and counts in training."""
    many = spark.range(40_000).selectExpr("cast(null as bigint) AS doc_id", "cast(null as string) AS text")
    some = spark.range(25_000).selectExpr("cast(7 as bigint) AS doc_id", "'the cat' AS text")
    other = spark.createDataFrame([(i, f"the hat {i}") for i in range(20)], "doc_id long, text string")
    got = Counter(map(tuple, ctw.score(many.unionByName(some).unionByName(other)).collect()))
    held = [i for i in range(20) if crc32(str(i).encode()) % 10 == 0]
    assert sum(got.values()) == 65_020 and sorted(got.values())[-2:] == [25_000, 40_000] and len(got) == 22
    assert {r[4] for r in got} == {40_000 + (0 if crc32(b"7") % 10 == 0 else 75_000) + 4 * (20 - len(held))}


@pytest.mark.parametrize("chars", [200, 5000])
def test_counted_rows_score_like_rows(documents, monkeypatch, chars):
    rows = [(i % 7, TEXTS[i % 7], "en", None) for i in range(90)] + [(None, TEXTS[0], "en", None)] * 5
    plain = ctw.score(documents(rows), block_chars=1 << 30).collect()
    monkeypatch.setattr(ctw, "EXPANDED", 4)
    counted = ctw.score(documents(rows), block_chars=chars).collect()
    key = lambda r: (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens)
    assert sorted(map(key, plain)) == sorted(map(key, counted))
    for a, b in zip(sorted(plain, key=key), sorted(counted, key=key)):
        assert a.score == pytest.approx(b.score, rel=1e-6) and a.base_score == pytest.approx(b.base_score, rel=1e-9)


def test_sums_of_more_texts_than_a_gram_leaves_bits_for():
    raws = [ctw.closed([w]) for w in (b"a", b"bc", b"cat")] * 11_000
    known = np.unique(np.concatenate([ctw.grams(r) for r in raws[:3]]))
    value = np.arange(1.0, len(known) + 1)
    assert np.allclose(ctw.document_sums(raws, value), np.tile(ctw.document_sums(raws[:3], value), 11_000))


def test_beats_word_frequencies_on_held_out_texts(spark):
    rows = [r for r in ctw.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty_and_untrained(documents):
    assert ctw.score(documents([(1, "x", None, None)]).limit(0)).collect() == []
    held = next(i for i in range(100) if crc32(str(i).encode()) % 10 == 0)
    r = ctw.score(documents([(held, "ab", None, None)])).first()
    assert (r.train_tokens, r.n_known) == (0, 0) and r.score == pytest.approx(-4 * 8 * log10(2))


def test_gamma():
    n = np.arange(0, 2000, 7.0)
    assert np.allclose(ctw.kt_log(n, n[::-1]), [lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(np.pi) for a, b in zip(n, n[::-1])], rtol=1e-12, atol=1e-9)
