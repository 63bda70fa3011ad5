"""The driver's tables as canonical streams and as raw exports written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["stream", "record_key", "canonical_person_id", "source", "source_file", "event_time", "run_id", "hk_type", "resource_type", "code", "status"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stream(df: DataFrame, stream: str, **columns) -> DataFrame:
    null = F.lit(None).cast("string")
    given = {"stream": F.lit(stream), "source": F.lit("fhir"), "source_file": F.lit("source/clinical.json"), "hk_type": null, "resource_type": null, "code": null, "status": null} | columns
    return df.select(*[given[c].alias(c) for c in COLUMNS])


def stream_of(spark: SparkSession, sf_dir: str, stream: str) -> DataFrame:
    """One canonical stream: observations, documents, medications or conditions."""
    text = lambda c: F.col(c).cast("string")
    if stream == "observations":
        kind = F.col("event_id") % 3
        return _stream(
            table(spark, sf_dir, "events"),
            stream,
            record_key=F.concat(F.lit("obs:"), text("event_id")),
            canonical_person_id=F.concat(F.lit("p"), text("user_id")),
            source=F.when(kind == 0, "healthkit").when(kind == 1, "fhir").otherwise("cda"),
            source_file=F.when(F.col("event_id") % 10 == 0, "ndjson/observations.ndjson").otherwise("source/export.xml"),
            event_time=F.when(F.col("event_id") % 50 != 0, F.date_trunc("second", "ts").cast("timestamp_ntz")),
            run_id=F.concat(F.lit("run"), (F.col("event_id") % 2).cast("string")),
            hk_type=F.when(kind == 0, F.col("event_type")),
            resource_type=F.when(kind == 1, F.lit("Observation")),
            code=F.when(kind == 2, F.col("event_type")),
        )
    if stream == "documents":
        hours = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id as int), 0, 0)")
        return _stream(
            table(spark, sf_dir, "documents"),
            stream,
            record_key=F.concat(F.lit("doc:"), text("doc_id")),
            canonical_person_id=F.concat(F.lit("p"), (F.col("doc_id") % 150).cast("string")),
            event_time=hours,
            run_id=F.lit("run0"),
            resource_type=F.lit("DocumentReference"),
            status=F.col("lang"),
        )
    if stream == "medications":
        return _stream(
            table(spark, sf_dir, "orders"),
            stream,
            record_key=F.concat(F.lit("med:"), text("o_orderkey")),
            canonical_person_id=F.concat(F.lit("p"), (F.col("o_custkey") % 150).cast("string")),
            event_time=F.col("o_orderdate").cast("timestamp_ntz"),
            run_id=F.lit("run1"),
            resource_type=F.lit("MedicationRequest"),
            status=F.col("o_orderstatus"),
        )
    if stream == "conditions":
        return _stream(
            table(spark, sf_dir, "customer"),
            stream,
            record_key=F.concat(F.lit("con:"), text("c_custkey")),
            canonical_person_id=F.concat(F.lit("p"), (F.col("c_custkey") % 150).cast("string")),
            event_time=F.lit(None).cast("timestamp_ntz"),
            run_id=F.lit("run1"),
            code=F.col("c_mktsegment"),
        )
    raise ValueError(f"no stream {stream}")


STREAMS = ("observations", "documents", "medications", "conditions")


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNION ALL of the four streams; column pruning reaches each table's scan."""
    first, *rest = (stream_of(spark, sf_dir, s) for s in STREAMS)
    for df in rest:
        first = first.unionByName(df)
    return first


#: The same mapping in SQL, to stand before a query over `ev`.
EVENTS_SQL = """WITH ev AS (
SELECT 'observations' AS stream, 'obs:' || event_id AS record_key, 'p' || user_id AS canonical_person_id,
 CASE event_id % 3 WHEN 0 THEN 'healthkit' WHEN 1 THEN 'fhir' ELSE 'cda' END AS source,
 CASE WHEN event_id % 10 = 0 THEN 'ndjson/observations.ndjson' ELSE 'source/export.xml' END AS source_file,
 CASE WHEN event_id % 50 <> 0 THEN date_trunc('second', ts) END AS event_time, 'run' || (event_id % 2) AS run_id,
 CASE WHEN event_id % 3 = 0 THEN event_type END AS hk_type, CASE WHEN event_id % 3 = 1 THEN 'Observation' END AS resource_type,
 CASE WHEN event_id % 3 = 2 THEN event_type END AS code, NULL::VARCHAR AS status FROM events
UNION ALL SELECT 'documents', 'doc:' || doc_id, 'p' || (doc_id % 150), 'fhir', 'source/clinical.json', TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR, 'run0', NULL, 'DocumentReference', NULL, lang FROM documents
UNION ALL SELECT 'medications', 'med:' || o_orderkey, 'p' || (o_custkey % 150), 'fhir', 'source/clinical.json', o_orderdate, 'run1', NULL, 'MedicationRequest', NULL, o_orderstatus FROM orders
UNION ALL SELECT 'conditions', 'con:' || c_custkey, 'p' || (c_custkey % 150), 'fhir', 'source/clinical.json', NULL, 'run1', NULL, NULL, c_mktsegment, NULL FROM customer)
"""


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset a folder of the warehouse takes
    its place; a temporary one of this machine only where Spark runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        alone = spark.sparkContext.master.startswith("local")
        base = tempfile.mkdtemp(prefix="vitalstream-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/vitalstream"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of new_folder() that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Meanwhile each write drops its shuffle files when it ends; else they stay until the driver has collected its garbage twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over as many tasks as the session shuffles to. A table of few bytes, which few tasks would read, may
    stand for much work, and a number that is given is not made smaller by the bytes that are shuffled."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written(df: DataFrame) -> DataFrame:
    """df written to a fresh shared folder and read back: computed once, its lineage cut."""
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
