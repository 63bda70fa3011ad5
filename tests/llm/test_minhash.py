import re

import numpy as np

from vitalstream.llm import minhash
from vitalstream.operators import skew


def brute(rows):
    """Components over all pairs, from plain sets of word tuples."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def fixture():
    rng = np.random.default_rng(4)
    word = lambda: "w" + str(rng.integers(0, 5000))
    rows = []
    for g in range(12):
        base = [word() for _ in range(int(rng.integers(6, 200)))]
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 25))):
                copy[int(rng.integers(0, len(copy)))] = word()
            rows.append((len(rows), " ".join(copy)))
    # A chain in which only neighbours are alike, four words, one word, blanks, nulls and equal texts in other letters.
    long = [word() for _ in range(400)]
    for k in range(6):
        rows.append((len(rows), " ".join(long[k * 25 : k * 25 + 250])))
    for text in ("a b c d", "A B\tC D", "a b c", "x", "X", "", None, " \n", "a b c d e", "É b c d e", "é b c d e", "big " * 30000, "BIG " * 40000):
        rows.append((len(rows), text))
    return rows


def test_matches_brute_force(documents):
    rows = fixture()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents([(i, t, None, None) for i, t in rows])).collect()}
    assert got == brute(rows)


def test_large_group_of_near_copies(documents):
    """Copies of one text with edits of their own: the hub of a bucket is like few of them, all are like the original."""
    rng = np.random.default_rng(9)
    base = [f"w{rng.integers(0, 9999)}" for _ in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for at in rng.choice(120, 3 if i else 0, replace=False):
            copy[at] = f"e{i}x{at}"
        rows.append((1000 - i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents([(i, t, None, None) for i, t in rows])).collect()}
    assert got == brute(rows)


def test_repeated_and_null_ids(documents):
    rows = [(1, "a b c d e f", "en", "a")] * 2 + [(None, "a b c d e f", None, None), (2, "a b c d e f", None, None)]
    got = sorted(map(tuple, minhash.near_duplicates(documents(rows)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)], key=str)
    assert {r.doc_id for r in minhash.deduplicated(documents(rows)).collect()} == {1, None}
    assert minhash.near_duplicates(documents(rows).limit(0)).collect() == []


def test_several_texts_under_one_id(documents):
    """Links of each of the texts count for the id."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "nothing of the kind here at all"), (1, None)]
    for order in (rows, rows[::-1]):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents([(*r, None, None) for r in order])).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_many_exact_copies(documents, monkeypatch):
    """Also where the rows of a set are spread over tasks."""
    monkeypatch.setattr(skew, "SMALL", 100)
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, text, None, None) for i in range(5, 3005)] + [(4, text + " x", None, None), (9999, "alone in all of this", None, None)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(rows)).collect()}
    assert got == {i: 4 for i in range(4, 3005)} | {9999: 9999}


def test_one_row_of_each_group(documents):
    """Repeated rows and rows without an id are copies too; two texts under one id are two documents."""
    rows = [(3, "a b c d e f", "en", "a")] * 3 + [(None, "a b c d e f", None, None)] * 2 + [(2, "A b c d e f", None, None)]
    rows += [(None, "only without an id here now", None, None)] * 4 + [(3, "another text under the same id", None, None)] + [(9, None, None, None)] * 2
    out = minhash.one_of_each(documents(rows).selectExpr("*", "1 AS row_no"))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(2, "A b c d e f"), (None, "only without an id here now"), (3, "another text under the same id"), (9, None), (9, None)], key=str)
    assert minhash.one_of_each(documents(rows).limit(0)).collect() == []


def test_signatures_estimate_similarity():
    a, b = minhash.shingle_hashes(" ".join(map(str, range(1000)))), minhash.shingle_hashes(" ".join(map(str, range(200, 1200))))
    circle = minhash.Circulant(512)
    s = circle.signatures([a, b])
    assert abs((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.08
