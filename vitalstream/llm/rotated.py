"""Embedding near-dedup by randomised-rotation binary codes with stored correction factors.

Unit vectors are turned by random rotations and kept as sign codes, one bit a component. With f = <code, turned vector> /
sqrt(d) stored beside a code, <code, turned query> / (sqrt(d) * f) is an unbiased estimate of the inner product of vector and
query, and its error is bounded with high confidence by EPSILON * sqrt((1 - f^2) / f^2) / sqrt(d - 1); means over
CODE_ROTATIONS rotations narrow both. The query side is the vector in eight bits a component; how far that is from the vector
is stored too and added to the bound. A pair is recomputed exactly, in double precision on the original vectors, only if
estimate plus bound reaches the threshold.

Equal vectors are one class and only the class takes part. Candidate pairs share a run of code bits, a bucket; a pair counts
in the first bucket that both share. Ids meet by bucket, codes travel to the buckets that several classes share, and vectors
only to the pairs that the codes leave open. Buckets of any size are compared in blocks of two chunks, and a block returns
counts and a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, release
from .runs import dealt_pairs, key_runs, pairs_of_chunks

EPSILON = 4.0
CODE_ROTATIONS = 4
#: Bits of a bucket beyond those that hold one vector a bucket: fewer strangers meet, for more tables of ids.
SPARSE_BITS = 4


@lru_cache(maxsize=256)
def rotation(dim: int, number: int) -> np.ndarray:
    """The number-th random rotation of dim dimensions: the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def tables_and_bits(rows: int, threshold: float, miss: float = 2e-4) -> tuple[int, int]:
    """Bits of a bucket key, growing with the rows so that unrelated vectors rarely share one, and as many keys as a pair at
    the threshold needs to share one with probability 1 - miss."""
    bits = max(6, ceil(log2(max(2, rows))) + SPARSE_BITS)
    share = (1 - np.arccos(threshold) / np.pi) ** bits
    return ceil(log(miss) / log(1 - share)), bits


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows whose vector is not null, not zero and has finite components only, v as array<double>."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def _unit(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each length of vector in the column v."""
    v = batch.column(batch.schema.get_field_index("v"))
    sizes = np.diff(v.offsets.to_numpy())
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
        x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
        yield at, x / np.sqrt((x * x).sum(1, keepdims=True))


class Coding:
    """The layout of codes of one dimension: which bits of which rotation make the key of which table."""

    def __init__(self, dim: int, keys: int, bits: int):
        self.dim, self.width = dim, min(dim, bits)
        self.per = max(1, dim // bits)
        self.rotations = max(CODE_ROTATIONS, -(-keys // self.per))
        k = np.arange(keys)
        self.first = (k // self.per) * dim + (k % self.per) * self.width  # a key's first bit among all bits

    def signs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All sign bits (vectors, rotations * dim), and the correction factors of the first CODE_ROTATIONS rotations."""
        out, f = [], []
        for t in range(self.rotations):
            turned = x @ rotation(self.dim, t).T
            out.append(turned > 0)
            if t < CODE_ROTATIONS:
                f.append(np.abs(turned).sum(1) / np.sqrt(self.dim))
        return np.concatenate(out, 1), np.stack(f, 1)

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """(vectors, keys): a hash of dimension, table and the table's bits."""
        out = np.empty((len(signs), len(self.first)), np.uint64)
        for k, a in enumerate(self.first):
            h = np.full(len(signs), (self.dim << 24) + k, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(31)
            for b in range(a, a + self.width, 32):
                part = signs[:, b : min(b + 32, a + self.width)]
                h = (h ^ (part @ (1 << np.arange(part.shape[1], dtype=np.uint64)))) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[:, k] = h
        return out.view(np.int64)

    def first_common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The first table whose key two vectors share, by their packed codes, pair by pair; -1 if there is none."""
        differ = np.unpackbits(x ^ y, axis=1)[:, : self.rotations * self.dim]
        sums = np.concatenate([np.zeros((len(x), 1), np.int32), differ.cumsum(1, dtype=np.int32)], 1)
        same = sums[:, self.first + self.width] == sums[:, self.first]
        return np.where(same.any(1), same.argmax(1), -1)


def codes(classes: DataFrame, keys: int, bits: int) -> DataFrame:
    """(rep, dim, code, f, near, scale, off, buckets) of classes (rep, v).

    code holds the packed sign bits of all rotations and f the correction factors of the first ones; near is the vector in
    eight bits a component, times scale, and off the length of what that misses; buckets lists the key of each table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column(0).to_numpy()
            for at, x in _unit(batch):
                coding = Coding(x.shape[1], keys, bits)
                signs, f = coding.signs(x)
                scale = np.abs(x).max(1) / 127
                near = np.rint(x / scale[:, None]).astype(np.int8)
                off = np.sqrt(((x - near * scale[:, None]) ** 2).sum(1))
                blob = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
                columns = [pa.array(reps[at]), pa.array(np.full(len(at), x.shape[1], np.int32)), blob(np.packbits(signs, axis=1)), blob(f), blob(near)]
                columns += [pa.array(scale), pa.array(off), pa.array(coding.keys(signs).tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "dim", "code", "f", "near", "scale", "off", "buckets"])

    return classes.select("rep", "v").mapInArrow(run, "rep long, dim int, code binary, f binary, near binary, scale double, off double, buckets array<long>")


def confidence(f: np.ndarray, dim: int) -> np.ndarray:
    """The bound of the estimates from codes with correction factors f (rows, rotations)."""
    spread = np.sqrt(np.maximum(0, 1 - f * f)) / f / np.sqrt(max(1, dim - 1))
    return EPSILON * np.sqrt((spread**2).sum(1)) / f.shape[1]


def estimate(sign: np.ndarray, turned: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Row by row, the inner product of a coded vector (signs, f) and a rotated one: (rows, rotations, components)."""
    return np.einsum("nt,nt->n", np.einsum("ntd,ntd->nt", sign, turned), 1 / f) / (f.shape[1] * np.sqrt(sign.shape[2]))


def _undecided(rows: pa.Table, starts: np.ndarray, threshold: float, keys: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (row numbers) of one batch of blocks that the codes leave open, each in its first common bucket only."""
    a, b = pairs_of_chunks(rows, starts)
    dims, table = rows["dim"].to_numpy(), rows["no"].to_numpy()
    same = dims[a] == dims[b]
    a, b = a[same], b[same]
    for d in np.unique(dims):
        coding = Coding(int(d), keys, bits)
        at = np.flatnonzero(dims == d)
        place = np.full(len(dims), -1)
        place[at] = np.arange(len(at))
        part = rows.take(pa.array(at))
        code, f, near = (np.frombuffer(b"".join(part[c].to_pylist()), t).reshape(len(at), -1) for c, t in (("code", np.uint8), ("f", "<f8"), ("near", np.int8)))
        vector = near * part["scale"].to_numpy()[:, None]
        turned = np.stack([vector @ rotation(int(d), t).T for t in range(CODE_ROTATIONS)], 1)
        sign = np.unpackbits(code, axis=1)[:, : CODE_ROTATIONS * d].reshape(len(at), CODE_ROTATIONS, d).astype(np.int8) * 2 - 1
        bound, off = confidence(f, int(d)), part["off"].to_numpy()
        mine = dims[a] == d
        i, j = place[a[mine]], place[b[mine]]
        for s in range(0, len(i), 4096):
            x, y = i[s : s + 4096], j[s : s + 4096]
            maybe = estimate(sign[x], turned[y], f[x]) + bound[x] + off[y] >= threshold
            x, y = x[maybe], y[maybe]
            first = coding.first_common(code[x], code[y]) == table[at[x]]
            yield at[x[first]], at[y[first]]


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """id -> smallest id that the links (a, b) of ids reach."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(ids[a].tolist(), ids[b].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def class_links(classes: DataFrame, keys: int, bits: int, threshold: float, chunk_rows: int) -> DataFrame:
    """(rep, n, root) from classes (rep, size, v): for blocks of classes, the rows that a class links with and the smallest
    class that the block's links reach. Several rows a class; no pair counts twice."""
    coded = materialize(codes(classes, keys, bits))
    rows = coded.select("rep", F.posexplode("buckets").alias("no", "bucket"))
    dealt = dealt_pairs(rows, "bucket", F.col("rep"), chunk_rows, coded.drop("buckets"), "rep")

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The classes of a block that have open pairs, each with its partners behind it."""
        for rows, starts in key_runs(batches, ["bucket", "i", "j"]):
            reps = rows["rep"].to_numpy()
            found = list(_undecided(rows, starts, threshold, keys, bits))
            a, b = (np.concatenate([p[k] for p in found]) if found else np.empty(0, np.int64) for k in (0, 1))
            if not len(a):
                continue
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            used, begin = np.union1d(a, b), np.searchsorted(a, np.union1d(a, b))
            end = np.append(begin[1:], len(a))
            partners = pa.array([reps[b[s:e]].tobytes() for s, e in zip(begin, end)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(rows[c].take(pa.array(used)).combine_chunks() for c in ("bucket", "i", "j", "rep")), partners], ["bucket", "i", "j", "rep", "partners"])

    undecided = materialize(dealt.mapInArrow(open_pairs, "bucket long, i int, j int, rep long, partners binary"))
    release(coded)
    partitions = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = undecided.join(classes, "rep").select("bucket", "i", "j", "rep", "partners", "size", "v").repartition(partitions, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in key_runs(batches, ["bucket", "i", "j"]):
            rows = rows.combine_chunks()
            reps, size = rows["rep"].to_numpy(), rows["size"].to_numpy()
            batch = rows.to_batches()[0]
            unit: dict[int, np.ndarray] = {}
            for at, x in _unit(batch):
                unit |= dict(zip(at.tolist(), x))
            linked: list[tuple[np.ndarray, np.ndarray]] = []
            partners = rows["partners"].to_pylist()
            for s, e in zip(starts, np.append(starts[1:], len(rows))):
                for i in range(s, e):
                    if partners[i]:
                        j = s + np.searchsorted(reps[s:e], np.frombuffer(partners[i], np.int64))
                        j = j[np.einsum("d,nd->n", unit[i], np.stack([unit[k] for k in j.tolist()])) >= threshold]
                        linked.append((np.full(len(j), i), j))
            a, b = (np.concatenate([p[k] for p in linked]) if linked else np.empty(0, np.int64) for k in (0, 1))
            if not len(a):
                continue
            own, where = np.unique(np.concatenate([reps[a], reps[b]]), return_inverse=True)
            n = np.bincount(where, np.concatenate([size[b], size[a]]), len(own)).astype(np.int64)
            roots = _forest(reps, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n), pa.array([roots[x] for x in own.tolist()], pa.int64())], ["rep", "n", "root"])

    return given.mapInArrow(exact, "rep long, n long, root long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, chunk_rows: int = 256) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Links join different rows with cosine >= threshold. Invalid vectors (null, zero, with null or non-finite components)
    have no links and are their own component; rows without an id too, with a null component. Vectors of different lengths
    have no cosine and no link. Rows with equal ids count as one vector, that of the first by components. Other columns
    are ignored.
    """
    vectors = materialize(valid_vectors(df, key, vector).groupBy("id").agg(F.min("v").alias("v")))
    classes = materialize(vectors.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    keys, bits = tables_and_bits(classes.count(), threshold)
    links = materialize(class_links(classes, keys, bits, threshold, chunk_rows))
    counted = links.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = classes.join(counted, "rep", "left").join(joined, F.col("rep") == joined["id"], "left")
    known = known.where("size > 1 or n is not null").select("v", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    found = vectors.join(known, "v").select("id", "n_links", "component")
    out = df.select(F.col(key).cast("long").alias("vec_id")).join(found, F.col("vec_id") == found["id"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"))
