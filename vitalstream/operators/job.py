"""A run in stages that can be taken up again.

Each stage reads what earlier ones wrote. Its output is written beside its place and put there by one rename, so a place that
exists is complete. A stage's place carries the fingerprint of the run's input and of the stages up to it: a run that was broken
off starts at the first stage without one. What each stage did is recorded in a table of stage events, and the run itself is
registered last, so an unfinished run is never taken for one that changed nothing.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Outputs = dict[str, DataFrame]
Stage = tuple[str, Callable[[Outputs], DataFrame]]

EVENTS = "run_id string, no int, stage string, state string, fingerprint string, rows long, seconds double"
RUNS = "run_id string, parent_run_id string, sha256 string, registered_at double"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _file_system(spark, path)
    return system.exists(where)


def commit(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write df to path as a whole or not at all. If another one was there first, that stays."""
    beside = f"{path}.part-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    system, source = _file_system(spark, beside)
    if exists(spark, path) or not system.rename(source, spark._jvm.org.apache.hadoop.fs.Path(path)):
        system.delete(source, True)


def _append(spark: SparkSession, rows: list[tuple], schema: str, path: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _table(spark: SparkSession, schema: str, path: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def stage_events(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, no, stage, state, fingerprint, rows, seconds): what each call did with each stage, run or kept."""
    return _table(spark, EVENTS, f"{root}/events")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, parent_run_id, sha256, registered_at) of the runs that have ended."""
    return _table(spark, RUNS, f"{root}/runs")


def run(spark: SparkSession, root: str, run_id: str, sha256: str, stages: list[Stage], parent: str | None = None) -> Outputs:
    """The stages' outputs by name, after running those that have none yet. sha256 is the fingerprint of the run's input."""
    done: Outputs = {}
    mark = sha256
    for no, (name, work) in enumerate(stages):
        mark = hashlib.sha256(f"{mark}:{name}".encode()).hexdigest()
        path, start = f"{root}/stages/{run_id}/{no:02}-{name}-{mark[:16]}", time.time()
        state = "kept" if exists(spark, path) else "run"
        if state == "run":
            commit(spark, work(dict(done)), path)
        done[name] = spark.read.parquet(path)
        _append(spark, [(run_id, no, name, state, mark, done[name].count(), time.time() - start)], EVENTS, f"{root}/events")
    if runs(spark, root).where(F.col("run_id") == run_id).isEmpty():
        _append(spark, [(run_id, parent, sha256, time.time())], RUNS, f"{root}/runs")
    return done


def report(spark: SparkSession, root: str) -> DataFrame:
    """One row per run: (run_id, parent_run_id, sha256, registered, stages, and for each stage name it had <stage>_rows and
    <stage>_executed), from what the stages recorded."""
    events = stage_events(spark, root)
    names = [r.stage for r in events.select("stage", "no").distinct().orderBy("no", "stage").collect()]
    of = lambda name, c: F.when(F.col("stage") == name, c)
    columns = [x for n in names for x in (F.max(of(n, F.col("rows"))).alias(f"{n}_rows"), F.coalesce(F.max(of(n, F.col("state") == "run")), F.lit(False)).alias(f"{n}_executed"))]
    each = events.groupBy("run_id").agg(F.count_distinct("stage").alias("stages"), *columns)
    known = runs(spark, root).select("run_id", "parent_run_id", "sha256", F.lit(True).alias("registered"))
    return each.join(known, "run_id", "left").withColumn("registered", F.coalesce("registered", F.lit(False)))
