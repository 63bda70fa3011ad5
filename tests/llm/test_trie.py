import hashlib
import random
import re
import zlib

import duckdb
import pytest

from vitalstream.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, part long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture
def conversations(spark):
    """Makes a table of (conv_id, turn, role, text) rows; three more columns clash with names the operator uses."""
    return lambda rows: spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def plainly(rows):
    """The contract, prefix by prefix."""
    digest = lambda r: hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()
    given = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, digest(r))):
        given.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    members, built = {}, {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = given.get(c - c % 20, [])[:h] + own[h:]
        for d in range(len(built[c]) + 1):
            members.setdefault(tuple(built[c][:d]), []).append(c)
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = sum(1 for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members))
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(path))))
        kids = sum(1 for p in members if len(p) == len(path) + 1 and p[: len(path)] == path)
        parent = min(members[path[:-1]]) if path else None
        out.append((min(who), len(path), parent, len(who), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in trie.prefix_trie(df).select(*COLUMNS).collect()), key=str)


def random_rows(rng, ids, turns, texts):
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in ids for t in range(rng.randint(1, turns))]


@pytest.mark.parametrize("shard, piece", [(2048, 512), (5, 2)])
def test_equals_the_plain_form(conversations, monkeypatch, shard, piece):
    """Also with shards of five pieces and pieces of two turns, where conversations cross several of both."""
    monkeypatch.setattr(trie, "SHARD_PIECES", shard)
    monkeypatch.setattr(trie, "PIECE", piece)
    rng = random.Random(shard)
    rows = random_rows(rng, [*range(0, 90), *range(1000, 1010)], 7, ["a", "a b", "", None, " x\ty\n"])
    rows += [(c, t, "user", "same words here") for c in range(300, 340) for t in range(5)]
    assert found(conversations(rows)) == plainly(rows)


def test_odd_rows(conversations):
    """Null ids and turns, equal turns, repeated rows, negative ids, and a head that is not there."""
    rows = [(None, 1, "user", "lost"), (40, None, "u", "first"), (40, 2, "u", "b"), (40, 2, "a", "b"), (40, 2, "a", "b"), (41, None, None, None), (41, 1, "", ""), (65, 1, "u", "x"), (66, 1, "u", "x"), (67, 1, "u", "x"), (68, 1, "u", "x")]
    assert found(conversations(rows)) == plainly(rows)
    minus = conversations([(-3, 1, "u", "x"), (-3, 2, "u", "y"), (-3, 3, "u", "y"), (-3, 4, "u", "z")])
    assert {r[0] for r in found(minus)} == {-3}
    assert found(conversations([]).limit(0)) == []


def test_one_long_conversation_and_many_copies(conversations):
    """A conversation of a third of all rows, and copies of another: sums over all of them are exact."""
    h = lambda c: zlib.crc32(str(c).encode()) % 4
    long = next(c for c in range(10001, 10100) if not h(c))
    copies = [c for c in range(20001, 30000) if not h(c)][:2000]
    rows = [(long, t, "u", f"turn {t} of it") for t in range(3000)] + [(c, t, "u", "two words") for c in copies for t in range(3)]
    got = {(r[0], r[1]): r for r in found(conversations(rows))}
    assert len(got) == 1 + 3000 + 3
    root = got[long, 0]
    assert root[3:7] == (2001, 2, 2, 1999 * 2 * 3)
    assert got[long, 1][2:7] == (long, 1, 1, 1, 0) and got[long, 3000][4:6] == (0, 1)
    end = got[copies[0], 3]
    assert end[2:7] == (copies[0], 2000, 0, 1, 1999 * 2)
    assert end[7] == hashlib.sha256(",".join(map(str, copies)).encode()).hexdigest()


def test_equals_sql(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    cursor = con.execute(trie.TRIE_SQL)
    names = [d[0] for d in cursor.description]
    wanted = sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in cursor.fetchall()), key=str)
    assert found(spark.read.parquet(path)) == wanted
