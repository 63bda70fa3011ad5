"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import spread_join

#: A round of few links is written by as few tasks as keep all cores busy, whatever the session shuffles to.
ROWS_PER_FILE = 100_000


def components(links: DataFrame, keep: Callable[[DataFrame], DataFrame], a: str = "a", b: str = "b", rounds: int = 60, drop: Callable[[DataFrame], None] = lambda df: None) -> DataFrame:
    """(id, component): for every id with a link the smallest id that links reach.

    keep cuts a round's lineage (a checkpoint or a written table), and drop frees what keep gave for an earlier round. A round keeps at most one row per link, so a hub costs as
    many rows as it has links; its minimum is pre-aggregated, and the join that brings it back spreads a hub's rows over
    several tasks. The loop ends when a round changes nothing; after `rounds` it raises.
    """
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = keep(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = state(edges)
    tasks = links.sparkSession.sparkContext.defaultParallelism
    for no in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread_join(both.where("v > u"), low, ["u"], F.col("v"), before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # Only ids with many smaller neighbours are frequent here, and a round leaves none of them.
        small = spread_join(large, least, ["u"], F.col("v"), before[0]) if no == 0 else large.join(least, "u")
        old, edges = edges, keep(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct().coalesce(max(tasks, ceil(before[0] / ROWS_PER_FILE))))
        now = state(edges)
        drop(old)
        if now == before:
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
