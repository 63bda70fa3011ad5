"""Joins that spread the rows of a frequent key over several tasks."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that has more than one in MOST_KEYS of the rows is spread; there are at most so many such keys, whatever the data,
#: so their list may come to the driver and be broadcast.
MOST_KEYS = 5000
#: Up to so many rows a join is left as it is: one task can have them all, and looking for frequent keys is a job of its own.
SMALL = 50_000


def spread_join(rows: DataFrame, other: DataFrame, keys: list[str], salt: Column, total: int, per_task: int = 1000, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined with other, which has one row per key, so that no task gets many rows of one key.

    total is the number of rows. Keys with more than max(per_task, total / MOST_KEYS) rows are cut into that many rows by
    salt, and other's row of such a key is repeated for each part; without such keys, or up to SMALL rows, it is a plain join. A null key joins
    nothing. how: inner or left. counts (keys, _rows) may say how many rows each key of other has, where that is known.
    """
    limit = max(per_task, ceil(total / MOST_KEYS))
    if total <= max(limit, SMALL):
        return rows.join(other, keys, how)
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    often = counts.where(F.col("_rows") > limit).select(*keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_parts"))
    found = often.collect()
    if not found:
        return rows.join(other, keys, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, often.schema))
    dealt = rows.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(salt), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = other.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")
