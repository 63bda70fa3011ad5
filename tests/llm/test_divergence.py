import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vitalstream.llm import divergence as dv

WORDS = re.compile(dv.WORD).findall


def plain_base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), rule by rule."""
    words = WORDS(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORDS(line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#|\xa0é", max_size=60))
def test_base_counts(text):
    words, *rest = dv.base_counts(text)
    assert (len(words), *rest) == plain_base(text)


def entropy(p):
    p = p[p > 0]
    return -(p * np.log2(p)).sum()


def plain_distance(p, q):
    p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
    return max(0, entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2) ** 0.5


def test_distance():
    assert dv.distance(np.array([1.0, 0]), np.array([0, 2.0])) == 1
    assert dv.distance(np.array([1.0, 1]), np.array([2.0, 2])) == 0
    assert dv.distance(np.zeros(2), np.ones(2)) == 1
    rng = np.random.default_rng(3)
    for _ in range(20):
        p, q = rng.integers(1, 50, 9), rng.integers(1, 50, 9)
        assert abs(dv.distance(p.astype(float), q.astype(float)) - plain_distance(p, q)) < 1e-9


def plain_references(rows):
    """{lang: (class counts, [(word, n)], words)} of (id, text, lang, source) rows."""
    out = {}
    every = sum(len(WORDS(r[1] or "")) for r in rows if r[2] is not None)
    for lang in {r[2] for r in rows} - {None}:
        texts = [r[1] or "" for r in rows if r[2] == lang]
        words = [w for t in texts for w in WORDS(t.lower())]
        if words and len(words) * dv.LANGUAGES >= every:
            common = Counter(w for w in words if len(w) <= dv.LONGEST and w.isalpha())
            out[lang] = (sum(dv.class_counts(t) for t in texts), sorted(common.items(), key=lambda x: (-x[1], x[0]))[: dv.COMMON], len(words))
    return out


def plain_verdict(text, lang, refs):
    classes, words = dv.class_counts(text), WORDS(text.lower())

    def fine(ref, with_words):
        chars, common, n = ref
        good = len(text) < 200 or plain_distance(classes, chars) <= 0.12 + 3 / len(text) ** 0.5
        if with_words and len(words) >= 50:
            own = [words.count(w) for w, _ in common]
            there = [k for _, k in common]
            good = good and plain_distance([*own, len(words) - sum(own)], [*there, n - sum(there)]) <= 0.2 + 1.6 / len(words) ** 0.5
        return good

    if not text:
        return True
    if lang in refs:
        return any(fine(ref, True) for ref in refs.values())
    return fine(min(refs.values(), key=lambda ref: plain_distance(classes, ref[0])), False)


def test_equals_the_plain_form(documents, corpus):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in corpus.collect()]
    rng = random.Random(1)
    rows += [(9000 + i, rng.choice(rows)[1], rng.choice(["en", None, "xx"]), "s") for i in range(30)]
    refs = plain_references(rows)
    assert set(refs) == {"en", "de", "fr", "es", *(r[2] for r in rows if r[2] == "xx")}
    got = {r.doc_id: r for r in dv.rules(documents(rows)).collect()}
    for i, text, lang, _ in rows:
        r, base = got[i], plain_base(text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert r.kept == (not r.base_failed and plain_verdict(text or "", lang, refs)), i


def test_labelled_documents(spark):
    """Documents labelled good stay, nearly all labelled bad of a hundred words and more go."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = dv.rules(docs).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q and (q or r.n_words >= 100)] for q in (1, 0))
    assert len(good) > 200 and sum(good) >= 0.998 * len(good)
    assert len(bad) > 20 and sum(bad) <= 0.1 * len(bad)


@pytest.mark.parametrize("lang", ["en", None, "rare"])
def test_odd_rows(documents, lang):
    good = "the cat sat on the mat and it was good to see that we all know what it does then "
    rng = random.Random(2)
    mixed = " ".join(rng.choice(good.split()) + " " + "".join(rng.choices("aeioulmnrst", k=5)) for _ in range(300))
    rows = [(None, None, lang, None), (1, "", lang, "s"), (2, " \n\t", lang, "s"), (3, mixed, lang, "s"), (3, mixed, lang, "s"), (4, "x" * 300000, lang, "s"), (5, (mixed + "\n") * 60, lang, "s")]
    base = [(100 + i, " ".join(rng.sample(mixed.split(), 400)), "en", "s") for i in range(200)]
    got = dv.rules(documents(rows + base)).collect()
    assert len(got) == len(rows) + len(base)
    by = {r.doc_id: r for r in got}
    assert (by[None].n_words, by[None].base_failed, by[None].kept) == (0, True, False) and not by[1].kept and not by[2].kept
    assert by[3].kept and by[4].base_failed and by[5].n_dup_lines == 59 and by[5].base_failed
    assert dv.rules(documents([]).limit(0)).collect() == []
