"""The event stream: what is left after deletes, and what a read of one person's day touches."""

import os

from vitalstream.sources import sinks

SCHEMA = "record_key string, canonical_person_id string, stream string, record_type string, day string, op string, seq int"


def files_read(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_a_persons_day_reads_few_files(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [(f"k{p}-{m}-{d}", f"p{p}", "observations", f"t{d % 3}", f"2024-{m:02}-{d:02}", "upsert", 1) for p in range(40) for m in range(1, 7) for d in (1, 9, 17)]
    sinks.event_stream(spark.createDataFrame(rows, SCHEMA), path)
    files = sum(f.endswith(".gz.parquet") for _, _, names in os.walk(path) for f in names)
    one = sinks.stream_events(spark, path, "observations", "p7", "2024-03-09")
    assert [r.record_key for r in one.collect()] == ["k7-3-9"]
    assert files >= 24 and files_read(sinks.stream_events(spark, path, "observations", "p7", "2024-03-09")) <= files / 8
    plan = spark._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "EqualTo(canonical_person_id,p7)" in plan and "EqualTo(day,2024-03-09)" in plan
    parts = plan.split("PartitionFilters:")[1].split("\n")[0]
    assert "month" in parts and "person_group" in parts and "stream" in parts
    assert sinks.stream_events(spark, path).count() == len(rows)
    assert sinks.stream_events(spark, path, day="2024-03-09").count() == 40 and sinks.stream_events(spark, path, person="nobody").count() == 0


def test_what_is_left_after_deletes(spark, tmp_path):
    """Events in several appends; a record that moves to another day and person, null days and persons, ties, repeated events."""
    path = str(tmp_path / "events")
    first = [("a", "p1", "s", "t", "2024-01-01", "upsert", 1), ("b", "p1", "s", "t", "2024-01-01", "upsert", 1), ("c", None, "s", None, None, "upsert", 1), ("a", "p1", "other", "t", "2024-01-01", "upsert", 1)]
    later = [("a", "p1", "s", "t", "2024-01-01", "delete", 2), ("b", "p2", "s", "t", "2024-02-03", "upsert", 2), ("d", "p1", "s", "t", None, "delete", 1), ("e", "p1", "s", "t", None, "delete", 3), ("e", "p1", "s", "t", None, "upsert", 3)]
    for rows in (first, later, later):
        sinks.event_stream(spark.createDataFrame(rows, SCHEMA), path)
    got = sorted(map(tuple, sinks.current_events(sinks.stream_events(spark, path)).collect()))
    assert got == [("other", "a", "p1", "t", "2024-01-01"), ("s", "b", "p2", "t", "2024-02-03"), ("s", "c", None, None, None), ("s", "e", "p1", "t", None)]
    sinks.event_stream(spark.createDataFrame([], SCHEMA), path)
    assert sinks.stream_events(spark, path).count() == 14


def test_a_hot_person_goes_to_several_files(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(f"k{i}", "hot", "s", "t", f"2024-01-{i % 28 + 1:02}", "upsert", 1) for i in range(4000)]
        sinks.event_stream(spark.createDataFrame(rows, SCHEMA), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(f.endswith(".gz.parquet") for _, _, names in os.walk(path) for f in names) > 1
    assert sinks.stream_events(spark, path, person="hot", day="2024-01-05").count() == sum(i % 28 == 4 for i in range(4000))
