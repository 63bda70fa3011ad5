import re

import duckdb
import pytest

from vitalstream.llm import mixing

ROWS = [(i, "w " * (i % 17 + 1), "en", f"s{i % 3}") for i in range(300)] + [(1000, None, "en", None), (1001, "a\tb c", None, None), (1002, "", "en", "empty"), (1003, "x " * 50000, "en", "big"), (7, "dup dup", "en", "s1")]


def by_hand(rows):
    """Water level by repeated resharing."""
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, rest = {}, set(order), 1.5 * sum(sizes.values())
    while left:
        unit = rest / sum(weight[s] for s in left)
        full = {s for s in left if unit * weight[s] >= 2 * sizes[s]}
        if not full:
            return sizes, target | {s: unit * weight[s] for s in left}
        target |= {s: 2.0 * sizes[s] for s in full}
        rest -= sum(target[s] for s in full)
        left -= full
    return sizes, target


def test_targets_and_budgets(documents):
    sizes, target = by_hand(ROWS)
    rows = mixing.mix(documents(ROWS), bucket_rows=20).collect()
    assert len(rows) == len(ROWS)
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in taken)
    again = mixing.mix(documents(ROWS).repartition(5), bucket_rows=20).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert sorted(map(repr, mixing.mix(documents(ROWS)).collect())) == sorted(map(repr, rows))


def test_sql_states_the_same(spark, corpus):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(mixing.MIX_SQL).fetchall()}
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.mix(corpus).collect()}
    assert {k: (*v[:2], pytest.approx(v[2]), v[3]) for k, v in want.items()} == got


def test_empty_and_wordless(documents):
    assert mixing.mix(documents(ROWS).limit(0)).collect() == []
    assert [r.taken for r in mixing.mix(documents([(1, None, None, None), (2, " ", None, "a")])).collect()] == [0, 0]


def test_documents_of_the_mix(documents):
    frame = documents([r for r in ROWS if r[0] not in (7,)]).selectExpr("*", "'own' AS mix_id", "0 AS mix_times", "0 AS MIX_COPY")
    times = {}
    for r in mixing.mixed_documents(frame).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert r.block == 1 and r.mix_id == "own"
    whole = {r.doc_id: r.taken // r.size for r in mixing.mix(frame, whole=True).collect() if r.taken}
    assert times == whole


def test_hot_ids_are_split(documents, monkeypatch):
    """Many rows without an id, or with one id: buckets of their own, the same totals as in one bucket."""
    rows = [(None, "a b c" if i % 3 else None, "en", "s1") for i in range(300)] + [(7, "w " * (i % 5), "en", "s1") for i in range(200)] + [(i, "x y", "en", "s2" if i % 2 else None) for i in range(10, 100)]
    one = sorted(map(tuple, mixing.mix(documents(rows), bucket_rows=10**6).collect()), key=str)
    split = mixing.mix(documents(rows), bucket_rows=20)
    assert sorted(map(tuple, split.collect()), key=str) == one
    monkeypatch.setattr(mixing, "MOST_HOT", 4)
    assert len(mixing.hot_keys(documents(rows).selectExpr("md5(coalesce(cast(doc_id as string), '')) AS mix_key"), 590, 20)) == 2


def test_rows_are_taken_one_by_one(documents):
    """Rows under one id, or without one, come as often as they are taken themselves."""
    rows = [(i, f"t{i} " * 10, "en", "a") for i in (None, 1, 2)] + [(None, f"n{k} " * 10, "en", "a") for k in range(30)] + [(1, "other words here", "en", "a"), (3, None, "en", "b"), (4, "b " * 5, "en", "b")]
    frame = documents(rows).selectExpr("*", "1 AS taken", "'q' AS mix_row")
    out = [tuple(r) for r in mixing.mixed_documents(frame).collect()]
    assert set(out) <= {tuple(r) for r in frame.collect()} and mixing.mixed_documents(frame).columns == frame.columns
    words = {s: sum(len((r[1] or "").split()) for r in out if r[3] == s) for s in "ab"}
    sizes = {s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in "ab"}
    goal = {r.source: r.target for r in mixing.mix(documents(rows)).collect()}
    assert all(abs(words[s] - goal[s]) <= 10 for s in "ab") and all(words[s] <= 2 * sizes[s] for s in "ab")
    assert not any(r[1] is None for r in out)
