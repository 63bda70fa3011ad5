import hashlib
from collections import Counter

import numpy as np

from vitalstream.llm import repeats


def brute(texts):
    """Counts all strings of 200 bytes; marks the bytes of those that occur twice."""
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - 199):
            if counts[r[i : i + 200]] > 1:
                gone[i : i + 200] = True
        starts = int((gone[:-1] & ~np.append(False, gone[:-1])[: len(r)]).sum())
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = np.random.default_rng(8)
    rand = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    a, b, c = rand(1000), rand(260), rand(199)
    rows = [a, a[100:700] + rand(50), rand(300) + a[300:520] + rand(10), rand(30) + a[310:509] + rand(300), b + rand(90) + b, rand(80) + b[20:235] + rand(80), c, c, c + "x", "y" + c + "z" + rand(100)]
    rows += [a[400:650] + rand(20) + a[200:460], rand(9) + a[450:800] + b[:205]]
    rows += ["a" * 201, "ab" * 300, "é" * 150 + rand(100), "日本" * 120, "", None, rand(150), a, rand(500), "x" * 199, "header " + a[:230] + " tail"]
    # Overlapping pieces of one passage: what repeats ends elsewhere in each.
    for i in range(30):
        u, v = sorted(rng.integers(0, 1000, 2).tolist())
        rows.append(rand(int(rng.integers(0, 60))) + a[u:v] + rand(int(rng.integers(0, 60))))
    return rows


def check(got, rows):
    want = brute([t for _, t in rows])
    by = {}
    for (i, _), w in zip(rows, want):
        by.setdefault(i, []).append(w)
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        assert r.n_removed == sum(x.end - x.start for x in r.removed)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in by.items()}


def test_matches_brute_force(documents):
    rows = list(enumerate(texts()))
    rows += [(3, rows[3][1]), (5, "another text " * 40), (None, "no id " * 40)]
    check(repeats.remove_repeats(documents([(i, t, "en", None) for i, t in rows])).collect(), rows)


def test_spans_of_equal_rows_are_listed_once(documents):
    text = texts()[0]
    one = repeats.spans_by_text(repeats.keyed(documents([(1, text, None, None), (2, text, None, None)]))).collect()
    rows = [(1, text, None, None)] * 200 + [(None, text, None, None)] * 200
    many = repeats.spans_by_text(repeats.keyed(documents(rows))).collect()
    assert len(one) == len(many) == 2 and max(len(r.spans) for r in many) <= max(len(r.spans) for r in one)
    check(repeats.remove_repeats(documents(rows)).collect(), [r[:2] for r in rows])


def test_long_texts_are_cut_into_parts(documents, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 256)
    raw = [t.encode() for t in texts() if t]
    whole = [list(x) for x in repeats.parts(raw)]
    starts = Counter((o, s + k) for _, owner, shift, ends in whole for o, s, a, z in zip(owner, shift, [0, *ends[:-1]], ends) for k in range(z - a - 199))
    assert starts == Counter((i, k) for i, r in enumerate(raw) for k in range(len(r) - 199))


def test_corpus(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(repeats.remove_repeats(df).collect(), [(r.doc_id, r.text) for r in df.collect()])


def test_part_of_one_text(documents, monkeypatch):
    """A long text alone in its part, then none with a string: the columns keep their types."""
    rows = [(1, "word " * 20000, None, None), (2, "x", None, None), (3, "y" * 199, None, None)]
    check(repeats.remove_repeats(documents(rows).repartition(1)).collect(), [r[:2] for r in rows])


def test_empty(documents):
    frame = documents([(1, "x", None, None)])
    assert repeats.remove_repeats(frame.limit(0)).collect() == []
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(frame).collect()] == [(1, 0, 0)]
