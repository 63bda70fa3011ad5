import numpy as np

from vitalstream.llm import rotated


def brute(ids, vectors, threshold=0.95):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    comp = np.array(ids)
    while True:
        low = np.minimum(comp, np.where(link, comp[None, :], max(ids) + 1).min(1))
        if (low == comp).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, link.sum(1), comp)}
        comp = low


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, bucket int")


def test_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 64))
    hub = rng.normal(size=64)
    x[:150] = hub + rng.normal(size=(150, 64)) * rng.uniform(0, 0.3, (150, 1))  # cosines on both sides of 0.95
    x[150:170] = x[149]
    x = x.astype(np.float32)
    got = {r.vec_id: (r.n_links, r.component_id) for r in rotated.near_duplicates(frame(spark, [(int(i) + 7, v.tolist()) for i, v in enumerate(x)]), chunk_rows=64).collect()}
    assert got == brute([i + 7 for i in range(400)], x)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 0.0]), (7, [2.0, 0.0]), (10, [1e30, 1e24])]
    got = sorted((tuple(r) for r in rotated.near_duplicates(frame(spark, rows)).collect()), key=str)
    want = [(i, 0, i, True) for i in (2, 3, 4, 5, 6, 8, 9)] + [(1, 2, 1, True), (7, 2, 1, False), (7, 2, 1, False), (10, 2, 1, False), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert rotated.near_duplicates(frame(spark, rows).limit(0)).collect() == []


def test_equal_vectors_are_one_class(spark):
    """Thousands of copies cost what one vector costs: no block holds them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 32)).astype(np.float32)
    x[1] = x[0] + np.float32(0.01)
    rows = [(i, x[i % 60].tolist()) for i in range(60 * 50)] + [(10_000 + i, x[0].tolist()) for i in range(4000)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rotated.near_duplicates(frame(spark, rows)).collect()}
    assert got[5] == got[65][:1] + (5, True) and got[5][0] == 49
    assert got[0] == (4049 + 50, 0, True) and got[1] == (49 + 4050, 0, False) and got[10_007] == (4099, 0, False)


def test_codes_say_what_the_keys_say():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 48))
    x = np.repeat(x / np.linalg.norm(x, axis=1)[:, None], 2, 0) + rng.normal(size=(100, 48)) * 0.02
    coding = rotated.Coding(48, 30, 10)
    signs, _ = coding.signs(x)
    keys, packed = coding.keys(signs), np.packbits(signs, axis=1)
    a, b = np.divmod(np.arange(100 * 100), 100)
    same = keys[a] == keys[b]
    assert (coding.first_common(packed[a], packed[b]) == np.where(same.any(1), same.argmax(1), -1)).all()
    assert len(np.unique(keys[:, 0])) > 20


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    d, x, y = 64, unit(rng.normal(size=(3000, 64))), unit(rng.normal(size=(3000, 64)))
    turned = [np.stack([v @ rotated.rotation(d, t).T for t in range(rotated.CODE_ROTATIONS)], 1) for v in (x, y)]
    f = np.abs(turned[0]).sum(2) / np.sqrt(d)
    off = rotated.estimate(np.sign(turned[0]), turned[1], f) - (x * y).sum(1)
    assert abs(off.mean()) < 0.005
    assert (np.abs(off) <= rotated.confidence(f, d)).mean() > 0.999
