import numpy as np
import pytest

from vitalstream.llm import neighbours


def brute(ids, vectors, asked, k):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in asked:
        score = x @ x[ids.index(q)]
        order = sorted((-s, i) for s, i in zip(score, ids) if i != q)[:k]
        out[q] = [(i, -s) for s, i in order]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, chunk int")


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids = [r.vec_id for r in rows]
    got = answers(neighbours.nearest(df, df.where("vec_id % 50 = 0")))
    want = brute(ids, [r.embedding for r in rows], [i for i in ids if i % 50 == 0], 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {(q, i): s for q in want for i, s in want[q]}
    for q in got:
        for i, s in got[q]:
            if (q, i) in exact:
                assert s == pytest.approx(exact[q, i], abs=1e-12)


def test_few_rows_ties_and_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0]), (2, [2.0, 2.0]), (4, None), (100, None), (150, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (3, [1.0, 1.0])]
    df = frame(spark, rows)
    got = answers(neighbours.nearest(df, df.where("vec_id % 50 = 0")))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [2, 3, 50], 50: [2, 3, 0]}
    assert neighbours.nearest(df.limit(0), df.limit(0)).collect() == []


def test_hot_bucket(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (np.ones(16) + rng.normal(size=16) * 0.01).tolist()) for i in range(400)] + [(i, rng.normal(size=16).tolist()) for i in range(400, 600)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    df = frame(spark, rows)
    got = answers(neighbours.nearest(df, df.where("vec_id % 50 = 0"), chunk_rows=64))
    want = brute([i for i, _ in rows], [v for _, v in rows], list(got), 5)
    hot = [q for q in got if q < 400]
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in hot)


def test_probes_follow_the_estimated_success():
    """Near neighbours need few buckets, far ones many, and the share of neighbours that probes meet is the one wanted."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    q = unit(rng.normal(size=(300, 64)))
    hashing, counts = neighbours.PStable(64, 3, 5, 1.6), []
    for cosine in (0.98, 0.8, 0.4):
        side = rng.normal(size=q.shape)
        side = unit(side - (side * q).sum(1)[:, None] * q)
        near = cosine * q + np.sqrt(1 - cosine**2) * side
        own, asked = hashing.keys(hashing.cells(near)[0], 64), hashing.probes(q, [cosine], 0.93)
        assert np.mean([np.isin(o, a).any() for o, a in zip(own, asked)]) > 0.88
        counts.append(np.mean([len(a) for a in asked]))
    assert counts[0] < 15 and counts[0] < counts[1] < counts[2]


def test_usual_cosines(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    vectors = neighbours.valid_vectors(df, "vec_id", "embedding")
    got = neighbours.usual_cosines(vectors, vectors.where("id % 10 = 0"), 5)
    want = brute(list(range(300)), x, range(0, 300, 10), 5)
    assert got == pytest.approx(list(np.quantile([s for v in want.values() for _, s in v], neighbours.QUANTILES)))
    assert neighbours.usual_cosines(vectors.limit(0), vectors.limit(0), 5) == [0.0]
