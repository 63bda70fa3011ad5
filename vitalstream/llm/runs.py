"""Sorted runs in Arrow batches: what several operators use to work on key groups without a Python call per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str], most_rows: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts) from batches that come sorted by keys: rows holds whole groups only, starts has each group's first row.

    The last group of a batch waits for the next batch, so a group is never split; its size is the caller's to bound.
    With most_rows, rows has no more than that, or one group: what the caller makes of the pairs in it is bounded too.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks()
        starts = group_starts(rows, keys)
        if len(starts) > 1:
            cut = int(starts[-1])
            yield from parts(rows.slice(0, cut), starts[:-1], most_rows)
            held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield from parts(rows, group_starts(rows, keys), most_rows)


def parts(rows: pa.Table, starts: np.ndarray, most_rows: int | None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """rows and starts in runs of whole groups of most_rows rows at most, a larger group alone."""
    if most_rows is None or len(rows) <= most_rows:
        yield rows, starts
        return
    ends, first = np.append(starts[1:], len(rows)), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + most_rows, "right")))
        yield rows.slice(starts[first], ends[last - 1] - starts[first]).combine_chunks(), starts[first:last] - starts[first]
        first = last


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    new[0] = True
    for key in keys:
        values = rows[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def pairs_within(starts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j), i < j, of all pairs inside each of the groups that begin at starts."""
    sizes = np.diff(np.append(starts, total))
    after = np.repeat(starts + sizes, sizes) - np.arange(total) - 1  # rows of the group behind each row
    i = np.repeat(np.arange(total), after)
    j = np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after) + i + 1
    return i, j


def dealt_pairs(rows: DataFrame, key: str, salt: Column, chunk_rows: int, payload: DataFrame, on: str) -> DataFrame:
    """rows with (i, j, own) and payload's columns by on: what tasks need to compare all rows of a key, none of which holds
    more than two chunks.

    A key's rows fall into ceil(count / chunk_rows) chunks by salt; each row goes once to every pair (i <= j) that its own
    chunk is part of. Keys with one row are left out, before any payload travels. Sorted by key, i, j within partitions.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("rows_of_key")).where("rows_of_key > 1")
    dealt = rows.join(counts, key).withColumn("chunks", F.ceil(F.col("rows_of_key") / chunk_rows).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(salt), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("rows_of_key", "chunks", "other")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.join(payload, on).repartition(partitions, key, "i", "j").sortWithinPartitions(key, "i", "j", "own")


def pairs_of_chunks(rows: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs to compare in groups (key, i, j): all of a chunk's own if i = j, else across the two."""
    a, b = pairs_within(starts, len(rows))
    own, i, j = (rows[c].to_numpy() for c in ("own", "i", "j"))
    use = (i[a] == j[a]) | (own[a] != own[b])
    return a[use], b[use]
