"""What the operators share: shared-folder tables, connected components, text blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.tables import shared_folder

#: The words of every word-based contract: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: each row is computed once and survives lost executors.

    The folder goes when the application ends. Spark drops the shuffle files of finished jobs only when the driver collects
    its garbage, so that is asked for here; else a chain of such tables would hold all its shuffles on disk.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vitalstream-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    spark._jvm.System.gc()
    written = spark.read.schema(df.schema).parquet(path)
    written.shared_path = path
    return written


def release(written: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more, once what was derived from it has been written."""
    where = written.sparkSession._jvm.org.apache.hadoop.fs.Path(written.shared_path)
    where.getFileSystem(written.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def pieces(batch: pa.RecordBatch, column: int | str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of some most_bytes of a text column, a longer text alone: a batch of Spark's has up to
    64 MB of text, and what is made of it by rows comes on top, in the Python worker and in the executor that reads it."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield batch.slice(start, end - start)
        start = end


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes not to clash with a column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def hashed_block(key: Column, blocks: int) -> Column:
    """A block number from 0 to blocks - 1 by the hash of key; nulls go to a block too."""
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id with a link the smallest id that links reach; each round is written to the shared folder,
    and deleted once the next one is."""
    return graph.components(links, materialize, a, b, drop=release)
