"""Sinks: canonical lines, device lines, reports and query results as files. Each is a folder of part files that Spark commits
as a whole; lines and rows end with a newline and stand in the stated order, part after part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import format_time
from .tables import STREAMS, spread, written

#: The order of canonical rows, NULL as empty.
SIX_KEYS = ("event_time", "canonical_person_id", "source", "source_file", "source_id", "event_key")


def json_line(columns: list[str]) -> Column:
    """A row as compact JSON with sorted keys, NULLs included."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})


def canonical_lines(events: DataFrame, path: str) -> None:
    """One output per stream below path, its lines in the order of SIX_KEYS; keys that the rows don't have count as empty."""
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("")) if k in events.columns else F.lit("") for k in SIX_KEYS]
    columns = [c for c in events.columns if c != "stream"]
    for stream in STREAMS:
        events.where(F.col("stream") == stream).orderBy(*[k for k, name in zip(keys, SIX_KEYS) if name in events.columns]).select(json_line(columns).alias("value")).write.text(f"{path}/{stream}")


def device_lines(rows: DataFrame, path: str) -> None:
    """Device rows as lines sorted by record_key."""
    rows.orderBy("record_key").select(json_line(rows.columns).alias("value")).write.text(path)


def csv_rows(df: DataFrame, path: str, *order: str) -> None:
    """A query result as CSV with a header: NULL as empty, timestamps as UTC text in whole seconds, rows in the order given."""
    kinds = dict(df.dtypes)
    cells = [F.coalesce(format_time(F.col(c)) if kinds[c].startswith("timestamp") else F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    (df.orderBy(*order) if order else df).select(*cells).write.option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def report_files(reports: dict[str, tuple[DataFrame, tuple[str, ...]]], path: str) -> None:
    """Reports (rows, order) by name: each as CSV and as JSON lines, below path."""
    for name, (df, order) in reports.items():
        df = written(df)
        csv_rows(df, f"{path}/csv/{name}", *order)
        df.orderBy(*order).select(json_line(df.columns).alias("value")).write.text(f"{path}/json/{name}")


#: Folders of an event stream by person; more where a group's month would pass some 100 MB.
PERSON_GROUPS = 4
_OPS = "record_key string, canonical_person_id string, record_type string, day string, op string, seq int, stream string, month string, person_group int"


def _person_group(person: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(person), F.lit(groups)).cast("int")


def event_stream(ops: DataFrame, path: str, groups: int = PERSON_GROUPS) -> None:
    """Append upsert and delete events (record_key, canonical_person_id, stream, record_type, day, op, seq) below path.

    Folders are stream, month and person group (a hash); in them rows are sorted by person, day and type in gzipped Parquet
    files, whose statistics leave out what lies between. Rows are dealt by ranges of all these keys, so a person with many
    rows goes to several tasks and files. A null day is in month `none`.
    """
    rows = ops.withColumn("month", F.coalesce(F.substring("day", 1, 7), F.lit("none"))).withColumn("person_group", _person_group(F.col("canonical_person_id"), groups))
    keys = ["stream", "month", "person_group", "canonical_person_id", "day", "record_type", "record_key"]
    rows = rows.repartitionByRange(int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    rows.write.mode("append").partitionBy("stream", "month", "person_group").option("compression", "gzip").parquet(path)


def stream_events(spark: SparkSession, path: str, stream: str | None = None, person: str | None = None, day: str | None = None, groups: int = PERSON_GROUPS) -> DataFrame:
    """The events below path, of a stream, a person and a day where given: other folders are not listed for reading, and
    files and row groups of the folders that are read are chosen by their statistics. groups is that of event_stream()."""
    rows = spark.read.schema(_OPS).parquet(path)
    if stream is not None:
        rows = rows.where(F.col("stream") == stream)
    if person is not None:
        rows = rows.where((F.col("person_group") == _person_group(F.lit(person), groups)) & (F.col("canonical_person_id") == person))
    if day is not None:
        rows = rows.where((F.col("month") == day[:7]) & (F.col("day") == day))
    return rows


def current_events(events: DataFrame) -> DataFrame:
    """One row per stream and record_key, as its last event (by seq, a delete before an upsert of the same seq) has it; deleted ones left out.

    The last event may move a record to another day or person, so give all events of the keys in question.
    """
    last = F.max_by(F.struct("op", "canonical_person_id", "record_type", "day"), F.struct("seq", (F.col("op") != "delete").alias("_up"), "day", "canonical_person_id", "record_type"))
    dealt = spread(events, "stream", "record_key")  # before the aggregate, which would sort the rows on both sides of a shuffle
    return dealt.groupBy("stream", "record_key").agg(last.alias("last")).where("last.op = 'upsert'").select("stream", "record_key", "last.canonical_person_id", "last.record_type", "last.day")
