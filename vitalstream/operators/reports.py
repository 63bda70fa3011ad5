"""Aggregate reports over the canonical streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import format_time, record_type, source_bucket
from ..sources.tables import STREAMS, written


def bucketed(events: DataFrame) -> DataFrame:
    return events.withColumn("bucket", source_bucket(F.col("source"), F.col("source_file")))


def stream_list(events: DataFrame) -> DataFrame:
    return events.sparkSession.createDataFrame([(s,) for s in STREAMS], "stream string")


def table_totals(events: DataFrame) -> DataFrame:
    """(stream, rows): four rows, 0 for a stream without any."""
    counts = events.groupBy("stream").agg(F.count("*").alias("n"))
    return stream_list(events).join(counts, "stream", "left").select("stream", F.coalesce("n", F.lit(0)).alias("rows"))


def distinct_people(events: DataFrame) -> DataFrame:
    """(stream, people), and a row `all`: exact counts, NULL ids left out. People are first made distinct per stream."""
    each = events.where("canonical_person_id is not null").groupBy("stream", "canonical_person_id").agg(F.lit(1).alias("one"))
    every = each.select(F.lit("all").alias("stream"), "canonical_person_id").distinct()
    return each.select("stream", "canonical_person_id").unionByName(every).groupBy("stream").agg(F.count("*").alias("people"))


def event_time_range(events: DataFrame) -> DataFrame:
    both = [events.select("stream", "event_time"), events.select(F.lit("all").alias("stream"), "event_time")]
    return both[0].unionByName(both[1]).groupBy("stream").agg(F.min("event_time").alias("min_event_time"), F.max("event_time").alias("max_event_time"))


def coverage_by_source(events: DataFrame) -> DataFrame:
    return bucketed(events).where("bucket is not null").groupBy("stream", F.col("bucket").alias("source")).agg(F.count("*").alias("rows"))


def coverage_by_person(events: DataFrame) -> DataFrame:
    """One conditional aggregation: rows of each stream and the time range of every person."""
    counts = [F.count_if(F.col("stream") == s).alias(f"{s}_rows") for s in STREAMS]
    return events.where("canonical_person_id is not null").groupBy("canonical_person_id").agg(*counts, F.min("event_time").alias("min_event_time"), F.max("event_time").alias("max_event_time"))


def timeline_daily_counts(events: DataFrame) -> DataFrame:
    dated = bucketed(events).where("event_time is not null and bucket is not null")
    return dated.groupBy(F.to_date("event_time").alias("day"), "stream", F.col("bucket").alias("source")).agg(F.count("*").alias("rows"))


def person_type_counts(events: DataFrame) -> DataFrame:
    label = F.concat(F.col("stream"), F.lit(":"), record_type(F.col("stream")))
    return events.where("canonical_person_id is not null").groupBy("canonical_person_id", label.alias("type")).agg(F.count("*").alias("rows"))


def top_types_per_person(events: DataFrame, k: int = 5) -> DataFrame:
    best = Window.partitionBy("canonical_person_id").orderBy(F.desc("rows"), "type")
    return person_type_counts(events).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def observation_signals(events: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent observation labels; device types first among equals."""
    labels = events.where("stream = 'observations'").groupBy(record_type(F.col("stream")).alias("label")).agg(F.count("*").alias("rows"))
    return labels.orderBy(F.desc("rows"), ~F.col("label").startswith("HK"), "label").limit(k)


def source_totals(events: DataFrame) -> DataFrame:
    """Three rows, 0 where absent."""
    fixed = events.sparkSession.createDataFrame([("healthkit",), ("fhir",), ("cda",)], "source string")
    counts = events.groupBy("source").agg(F.count("*").alias("n"))
    return fixed.join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("rows"))


def run_label(events: DataFrame) -> DataFrame:
    """One row: the only run id, multiple(n), or unknown. Run ids are made distinct before they meet."""
    ids = events.where("run_id is not null and run_id <> ''").select("run_id").distinct()
    n = F.count("*")
    return ids.agg(F.when(n == 1, F.max("run_id")).when(n > 1, F.concat(F.lit("multiple("), n.cast("string"), F.lit(")"))).otherwise("unknown").alias("run_label"))


def person_summary(events: DataFrame) -> DataFrame:
    """Coverage per person with the top types as one text, most frequent first."""
    top = top_types_per_person(events).groupBy("canonical_person_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "type", "rows"))), lambda t: F.concat_ws("=", t["type"], t["rows"].cast("string"))), ";").alias("top_types")
    )
    return coverage_by_person(events).join(top, "canonical_person_id", "left")


def facts(events: DataFrame) -> DataFrame:
    """Rows and time range per (stream, source, bucket, person, type, run): one aggregate of which every report figure is a
    further sum. It is written, so that a report reads the events once however many figures it has."""
    kinds = bucketed(events).groupBy("stream", "source", "bucket", "canonical_person_id", record_type(F.col("stream")).alias("label"), "run_id")
    return written(kinds.agg(F.count("*").alias("n"), F.min("event_time").alias("low"), F.max("event_time").alias("high")))


def _top_types(f: DataFrame, k: int = 5) -> DataFrame:
    types = f.where("canonical_person_id is not null").groupBy("canonical_person_id", F.concat(F.col("stream"), F.lit(":"), F.col("label")).alias("type")).agg(F.sum("n").alias("rows"))
    best = Window.partitionBy("canonical_person_id").orderBy(F.desc("rows"), "type")
    return types.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def report_summary(events: DataFrame) -> DataFrame:
    """Every figure of the report as (section, key, value) rows, from one pass over the events."""
    f = facts(events)
    named = lambda section, key, value: F.struct(F.lit(section).alias("section"), key.alias("key"), value.cast("string").alias("value"))
    per = f.groupBy("stream").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    every = per.agg(F.min("low").alias("low"), F.max("high").alias("high")).select(F.lit("all").alias("stream"), "low", "high")
    spans = per.select("stream", "low", "high").unionByName(every)
    ends = spans.select(F.explode(F.array(named("min_event_time", F.col("stream"), format_time(F.col("low"))), named("max_event_time", F.col("stream"), format_time(F.col("high"))))).alias("x"))
    totals = stream_list(events).join(per.select("stream", "n"), "stream", "left").select(named("rows", F.col("stream"), F.coalesce("n", F.lit(0))).alias("x"))
    people = distinct_people(f).select(named("people", F.col("stream"), F.col("people")).alias("x"))
    source = f.where("bucket is not null").groupBy("stream", "bucket").agg(F.sum("n").alias("n")).select(named("source", F.concat_ws(":", "stream", "bucket"), F.col("n")).alias("x"))
    top = _top_types(f).select(named("top_type", F.concat_ws(":", "canonical_person_id", F.col("rank").cast("string")), F.concat_ws("=", "type", F.col("rows").cast("string"))).alias("x"))
    return totals.unionByName(people).unionByName(ends).unionByName(source).unionByName(top).select("x.*")


#: Fixed values of the note: its first and last line.
TITLE = "Summary of health events"
CLOSING = "Figures only: names, dates of birth and texts stay out."


def clinical_note(events: DataFrame) -> DataFrame:
    """(ord, line): the one-screen note, whole also without any event. The last event time stands for the time of making.

    One aggregate over the facts holds what the lines need; distinct people, run ids and labels are grouped before they meet.
    """
    f = facts(events)
    streams = [F.coalesce(F.sum(F.when(F.col("stream") == s, F.col("n"))), F.lit(0)).alias(s) for s in STREAMS]
    sources = [F.coalesce(F.sum(F.when(F.col("source") == s, F.col("n"))), F.lit(0)).alias(f"from_{s}") for s in ("healthkit", "fhir", "cda")]
    figures = f.agg(*streams, *sources, F.min("low").alias("low"), F.max("high").alias("high"))
    people = f.where("canonical_person_id is not null").select("canonical_person_id").distinct().agg(F.count("*").alias("people"))
    labels = f.where("stream = 'observations'").groupBy("label").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), ~F.col("label").startswith("HK"), "label").limit(5)
    signals = labels.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rows")).alias("n"), (~F.col("label").startswith("HK")).alias("o"), "label"))), lambda s: F.concat(s["label"], F.lit(":"), (-s["n"]).cast("string"))), ";").alias("signals"))
    row = lambda df: df.withColumn("one", F.lit(1))
    all_figures = row(figures).join(row(people), "one").join(row(run_label(f)), "one").join(row(signals), "one")  # one row each
    low, high = format_time(F.col("low")), format_time(F.col("high"))
    lines = [
        F.lit(TITLE),
        F.concat(F.lit("run_id="), "run_label"),
        F.concat(F.lit("generated_at="), F.coalesce(high, F.lit("1970-01-01T00:00:00Z"))),
        F.concat(F.lit("people="), F.col("people").cast("string")),
        F.concat(F.lit("event_time_range="), F.coalesce(F.concat(low, F.lit(".."), high), F.lit(""))),
        *[F.concat(F.lit(f"totals.{s}="), F.col(s).cast("string")) for s in STREAMS],
        *[F.concat(F.lit(f"sources.{s}="), F.col(f"from_{s}").cast("string")) for s in ("healthkit", "fhir", "cda")],
        F.when(F.col("signals") != "", F.concat(F.lit("signals.top_observations="), "signals")),
        F.lit(CLOSING),
    ]
    return all_figures.select(F.posexplode(F.array(*lines)).alias("pos", "line")).where("line is not null").select((F.col("pos") + 1).alias("ord"), "line")
