"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a unit vector by several functions floor((a . v + b) / w) with Gaussian a (2-stable, so distances in a hash
follow those between vectors). A query looks into its own bucket and then into perturbed ones, in the order of estimated
success: the probability that a neighbour falls into the bucket, given how near the neighbours of a few queries are. It stops
when the buckets of its tables hold a neighbour with the wanted probability, so well separated data take few probes. The
candidates of all tables are ranked by exact cosine. Queries and vectors meet by bucket in Spark's shuffle; a bucket is cut
into chunks of bounded size, and a chunk returns each query's best few only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import ceil, erf, log10, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .rotated import _unit, valid_vectors
from .runs import key_runs

REACH = 1  # cells to either side that a function is perturbed by
#: Queries whose true neighbours are found to learn how near neighbours are, and the quantiles that stand for them.
SAMPLED_QUERIES = 64
QUANTILES = (0.125, 0.375, 0.625, 0.875)
_erf = np.vectorize(erf, otypes=[float])


class PStable:
    """tables x functions of one width; seeded, so the same on every machine."""

    def __init__(self, dim: int, tables: int, functions: int, width: float, seed: int = 23):
        rng = np.random.default_rng([dim, seed])
        # Orthogonal directions within a table: each sees a different part of the distance.
        self.a = np.stack([np.linalg.qr(rng.normal(size=(dim, max(1, min(dim, functions)))))[0].T * np.sqrt(dim) for _ in range(tables)])
        self.b = rng.uniform(0, width, (tables, self.a.shape[1]))
        self.width, self.tables, self.functions = width, tables, self.a.shape[1]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, tables, functions): the cell numbers, and the place inside the cell from 0 to 1."""
        at = (np.einsum("nd,tfd->ntf", x, self.a) + self.b) / self.width
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    def keys(self, cells: np.ndarray, dim: int) -> np.ndarray:
        """One number for (length of vector, table, cells); different buckets share one with negligible chance."""
        table = np.arange(self.tables, dtype=np.uint64).reshape(-1, *[1] * (cells.ndim - 3))
        h = (np.full(cells.shape[:-1], dim, np.uint64) + (table << np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
        for f in range(self.functions):
            h = (h ^ cells[..., f].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def probes(self, x: np.ndarray, cosines: list[float], success: float) -> list[np.ndarray]:
        """For each vector the keys of the buckets to look into, over all tables, the most promising of a table first.

        A neighbour at cosine c of a query projected to t is projected to a normal place around c * t. The probability of a
        perturbed cell is the product over the functions, averaged over the cosines. A table is left when its cells reach
        the share that all tables together need for the success wanted.
        """
        cell, inside = self.cells(x)
        t = (cell + inside) * self.width - self.b[:, :]
        steps = np.arange(-REACH, REACH + 1)
        edges = (cell[..., None] + np.arange(-REACH, REACH + 2)) * self.width - self.b[:, :, None]
        moves = np.array(list(product(range(len(steps)), repeat=self.functions)), np.int64)
        chance = np.zeros((*cell.shape[:2], len(moves)))
        for c in cosines:
            below = 0.5 * (1 + _erf((edges - c * t[..., None]) / (sqrt(2) * max(0.02, sqrt(max(0.0, 1 - c * c))))))
            each = np.diff(below, axis=-1)
            part = np.ones_like(chance)
            for f in range(self.functions):
                part *= each[:, :, f, :][:, :, moves[:, f]]
            chance += part / len(cosines)
        order = np.argsort(-chance, axis=2, kind="stable")
        reached = np.cumsum(np.take_along_axis(chance, order, 2), axis=2)
        wanted = 1 - (1 - success) ** (1 / self.tables)
        counts = 1 + (reached < wanted).sum(2).clip(max=len(moves) - 1)
        keys = self.keys(cell[:, :, None, :] + steps[moves[order]], x.shape[1])
        return [np.concatenate([k[:n] for k, n in zip(own, count)]) for own, count in zip(keys, counts)]


def functions_for(rows: int) -> int:
    """Hash functions of a table: one more for every tenfold number of vectors, so that buckets grow slowly with it."""
    return max(1, min(8, round(log10(max(1, rows)) + 0.6)))


def usual_cosines(vectors: DataFrame, asked: DataFrame, k: int) -> list[float]:
    """QUANTILES of the cosines of SAMPLED_QUERIES queries (least by hash) and their k true neighbours, by one pass over all
    vectors; [0.0] if no query has a neighbour."""
    sample = [(r.id, np.array(r.v)) for r in asked.orderBy(F.xxhash64("id"), "id").limit(SAMPLED_QUERIES).collect()]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, x in _unit(batch):
                for i, v in sample:
                    if len(v) == x.shape[1]:
                        v = v / np.abs(v).max()
                        score = x @ (v / np.sqrt(v @ v))
                        score = score[ids[at] != i]
                        top = np.partition(score, -min(k, len(score)))[-k:] if len(score) else score
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), i)), pa.array(top)], ["id", "score"])

    found = vectors.select("id", "v").mapInArrow(best, "id long, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score")))
    scores = [r.score for r in found.withColumn("rank", rank).where(F.col("rank") <= k).select("score").collect()]
    return [float(c) for c in np.quantile(scores, QUANTILES)] if scores else [0.0]


def nearest(
    df: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    tables: int = 3,
    width: float = 1.6,
    success: float = 0.93,
    chunk_rows: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest rows of df by cosine, its own id left out.

    Nearest first, ties to the smaller id; all candidates if df has fewer. success is the wanted probability that a
    neighbour's bucket is looked into. Queries that meet fewer than k candidates are compared with all rows, in blocks.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id; vectors of
    different lengths are no candidates for each other. Rows with equal ids count once. Other columns are ignored.
    """
    vectors = materialize(valid_vectors(df, key, vector).groupBy("id").agg(F.min("v").alias("v")))
    asked = materialize(valid_vectors(queries, key, vector).groupBy("id").agg(F.min("v").alias("v")))
    rows = vectors.count()
    functions = functions_for(rows)
    cosines = usual_cosines(vectors, asked, k)

    def hashed(many: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for at, x in _unit(batch):
                    hashing = PStable(x.shape[1], tables, functions, width)
                    for s in range(0, len(at), 256):
                        part, u = at[s : s + 256], x[s : s + 256]
                        keys = hashing.probes(u, cosines, success) if many else hashing.keys(hashing.cells(u)[0], x.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array([r.tobytes() for r in u], pa.binary()), pa.array([r.tolist() for r in keys], pa.list_(pa.int64()))], ["id", "unit", "buckets"])

        return run

    own = materialize(vectors.select("id", "v").mapInArrow(hashed(False), "id long, unit binary, buckets array<long>")).select("id", "unit", F.explode("buckets").alias("bucket"))
    looked = materialize(asked.select("id", "v").mapInArrow(hashed(True), "id long, unit binary, buckets array<long>")).select("id", "unit", F.explode("buckets").alias("bucket"))
    best = _met(own, looked, k, chunk_rows)
    best = materialize(best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    few = asked.join(best.groupBy("query_id").count().where(F.col("count") >= k), asked["id"] == F.col("query_id"), "left_anti")
    # The exact way for queries that met too few: one bucket per block of all rows, into which each of them looks.
    blocks = max(1, ceil(rows / chunk_rows))
    exact = lambda df: df.select("id", "v").mapInArrow(_units, "id long, unit binary").withColumn("dim", F.octet_length("unit").cast("long"))
    block = lambda b: F.shiftleft("dim", 32) + b
    all_rows = exact(vectors).withColumn("bucket", block(F.pmod(F.xxhash64("id"), F.lit(blocks)))).drop("dim")
    all_few = exact(few).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))).withColumn("bucket", block(F.col("b"))).drop("dim", "b")
    best = best.unionByName(_met(all_rows, all_few, k, chunk_rows)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, x in _unit(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "unit"])


def _first(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    begin = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, int)
    place = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
    return query[place < k], ids[place < k], score[place < k]


def _met(own: DataFrame, looked: DataFrame, k: int, chunk_rows: int) -> DataFrame:
    """(query_id, vec_id, score): of each bucket's chunk the k best for each query that looks into the bucket."""
    counts = own.groupBy("bucket").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    rows = own.join(counts, "bucket").select("bucket", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.lit(0).alias("side"), "id", "unit")
    asks = looked.join(counts, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("side"), "id", "unit")
    partitions = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.unionByName(asks).repartition(partitions, "bucket", "chunk").sortWithinPartitions("bucket", "chunk", "side", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met, starts in key_runs(batches, ["bucket", "chunk"]):
            side, ids, raw = met["side"].to_numpy(), met["id"].to_numpy(), met["unit"].to_pylist()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, z in zip(starts, np.append(starts[1:], len(met))):
                split = a + int(np.searchsorted(side[a:z], 1))
                if split == a or split == z:
                    continue
                x = np.frombuffer(b"".join(raw[a:split]), "<f8").reshape(split - a, -1)
                for q0 in range(split, z, 512):
                    q1 = min(z, q0 + 512)
                    q = np.frombuffer(b"".join(raw[q0:q1]), "<f8").reshape(q1 - q0, -1)
                    if q.shape[1] != x.shape[1]:
                        continue
                    score = q @ x.T
                    score[ids[q0:q1, None] == ids[None, a:split]] = -np.inf
                    least = np.partition(score, -min(k, split - a), axis=1)[:, -min(k, split - a)]
                    # A product's last bits depend on its shape, so what may be among the best is scored pair by pair.
                    row, col = np.nonzero((score >= least[:, None] - 1e-9) & (score > -np.inf))
                    out.append(_first(ids[q0:q1][row], ids[a:split][col], np.einsum("nd,nd->n", q[row], x[col]), k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    return dealt.mapInArrow(compare, "query_id long, vec_id long, score double")
