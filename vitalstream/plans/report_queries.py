"""Queries of the report operators over the mapped streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import format_time, record_type, source_bucket
from ..operators import adhoc, reports
from ..sources import sinks
from ..sources.tables import EVENTS_SQL, STREAMS, all_events, new_folder, stream_of

over = lambda f: lambda spark, sf: f(all_events(spark, sf))

BUCKET = "CASE WHEN source_file LIKE 'ndjson/%' THEN 'ios' ELSE source END"
LABEL = (
    "CASE stream WHEN 'observations' THEN COALESCE(hk_type, resource_type, code, 'unknown') WHEN 'conditions' THEN COALESCE(resource_type, code, 'unknown') "
    "ELSE COALESCE(resource_type, 'unknown') END"
)
STAMP = "'%Y-%m-%dT%H:%M:%SZ'"
TOTALS = "SELECT s.stream, COUNT(ev.stream) AS rows FROM (VALUES ('observations'), ('documents'), ('medications'), ('conditions')) s(stream) LEFT JOIN ev ON ev.stream = s.stream GROUP BY 1"
PEOPLE = "SELECT stream, COUNT(DISTINCT canonical_person_id) AS people FROM ev GROUP BY 1 UNION ALL SELECT 'all', COUNT(DISTINCT canonical_person_id) FROM ev"
SPAN = "SELECT stream, MIN(event_time) AS min_event_time, MAX(event_time) AS max_event_time FROM ev GROUP BY 1 UNION ALL SELECT 'all', MIN(event_time), MAX(event_time) FROM ev"
BY_SOURCE = f"SELECT stream, {BUCKET} AS source, COUNT(*) AS rows FROM ev WHERE {BUCKET} IS NOT NULL GROUP BY 1, 2"
BY_PERSON = (
    "SELECT canonical_person_id, COUNT(*) FILTER (stream = 'observations') AS observations_rows, COUNT(*) FILTER (stream = 'documents') AS documents_rows, "
    "COUNT(*) FILTER (stream = 'medications') AS medications_rows, COUNT(*) FILTER (stream = 'conditions') AS conditions_rows, "
    "MIN(event_time) AS min_event_time, MAX(event_time) AS max_event_time FROM ev WHERE canonical_person_id IS NOT NULL GROUP BY 1"
)
TYPES = f"SELECT canonical_person_id, stream || ':' || {LABEL} AS type, COUNT(*) AS rows FROM ev WHERE canonical_person_id IS NOT NULL GROUP BY 1, 2"
TOP = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_person_id ORDER BY rows DESC, type) AS rank FROM ({TYPES})) WHERE rank <= 5"
SIGNALS = f"SELECT {LABEL} AS label, COUNT(*) AS rows FROM ev WHERE stream = 'observations' GROUP BY 1 ORDER BY 2 DESC, label NOT LIKE 'HK%', 1 LIMIT 5"
SOURCES = "SELECT s.source, COUNT(ev.source) AS rows FROM (VALUES ('healthkit'), ('fhir'), ('cda')) s(source) LEFT JOIN ev ON ev.source = s.source GROUP BY 1"
RUN = "SELECT CASE COUNT(DISTINCT run_id) WHEN 0 THEN 'unknown' WHEN 1 THEN MAX(run_id) ELSE 'multiple(' || COUNT(DISTINCT run_id) || ')' END AS run_label FROM ev WHERE run_id <> ''"
SUMMARY = f"""SELECT 'rows' AS section, stream AS key, rows::VARCHAR AS value FROM ({TOTALS}) UNION ALL SELECT 'people', stream, people::VARCHAR FROM ({PEOPLE})
UNION ALL SELECT 'min_event_time', stream, strftime(min_event_time, {STAMP}) FROM ({SPAN}) UNION ALL SELECT 'max_event_time', stream, strftime(max_event_time, {STAMP}) FROM ({SPAN})
UNION ALL SELECT 'source', stream || ':' || source, rows::VARCHAR FROM ({BY_SOURCE}) UNION ALL SELECT 'top_type', canonical_person_id || ':' || rank, type || '=' || rows FROM ({TOP})"""
NOTE = f"""SELECT 1 AS ord, 'Summary of health events' AS line UNION ALL SELECT 2, 'run_id=' || run_label FROM ({RUN})
UNION ALL SELECT 3, 'generated_at=' || COALESCE(strftime(max_event_time, {STAMP}), '1970-01-01T00:00:00Z') FROM ({SPAN}) WHERE stream = 'all'
UNION ALL SELECT 4, 'people=' || people FROM ({PEOPLE}) WHERE stream = 'all'
UNION ALL SELECT 5, 'event_time_range=' || COALESCE(strftime(min_event_time, {STAMP}) || '..' || strftime(max_event_time, {STAMP}), '') FROM ({SPAN}) WHERE stream = 'all'
UNION ALL SELECT CASE stream WHEN 'observations' THEN 6 WHEN 'documents' THEN 7 WHEN 'medications' THEN 8 ELSE 9 END, 'totals.' || stream || '=' || rows FROM ({TOTALS})
UNION ALL SELECT CASE source WHEN 'healthkit' THEN 10 WHEN 'fhir' THEN 11 ELSE 12 END, 'sources.' || source || '=' || rows FROM ({SOURCES})
UNION ALL SELECT 13, 'signals.top_observations=' || string_agg(label || ':' || rows, ';' ORDER BY rows DESC, label NOT LIKE 'HK%', label) FROM ({SIGNALS}) HAVING COUNT(*) > 0
UNION ALL SELECT 14, 'Figures only: names, dates of birth and texts stay out.'"""


JOINED = (
    "SELECT o.canonical_person_id, o.n AS observation_rows, m.n AS medication_rows FROM (SELECT canonical_person_id, COUNT(*) AS n FROM stream_observations GROUP BY 1) o "
    "JOIN (SELECT canonical_person_id, COUNT(*) AS n FROM stream_medications GROUP BY 1) m ON o.canonical_person_id = m.canonical_person_id WHERE o.n < m.n"
)
#: Windows, subtotals and sets over all streams, in words that both engines know.
TOTALLED = (
    "WITH every AS (SELECT stream, source, run_id, event_time FROM stream_observations UNION ALL SELECT stream, source, run_id, event_time FROM stream_documents "
    "UNION ALL SELECT stream, source, run_id, event_time FROM stream_medications UNION ALL SELECT stream, source, run_id, event_time FROM stream_conditions), "
    "totals AS (SELECT stream, source, COUNT(*) AS n, MAX(event_time) AS latest FROM every WHERE EXISTS (SELECT 1 FROM stream_medications m WHERE m.run_id = every.run_id) GROUP BY GROUPING SETS ((stream, source), (stream), ())) "
    "SELECT stream, source, n, latest, RANK() OVER (ORDER BY n DESC) AS place FROM totals"
)


def adhoc_sql(spark, sf):
    """Any SQL that only reads, over the four streams."""
    return adhoc.query(spark, JOINED, {f"stream_{s}": stream_of(spark, sf, s) for s in STREAMS})


def totalled(spark, sf):
    """Totals of the sources whose runs have medications. The medications' runs repeat row by row, and Spark takes their bytes,
    of a column that is no column of the file, for next to nothing and sends all rows everywhere; so they are shuffled, and the
    hash table of the semi-join holds each run once."""
    streams = {s: stream_of(spark, sf, s) for s in STREAMS}
    streams["medications"] = streams["medications"].hint("shuffle_hash")
    return adhoc.query(spark, TOTALLED, {f"stream_{s}": df for s, df in streams.items()})


def adhoc_csv(spark, sf):
    """The result of an SQL text as CSV, in its rows' order, read back without its header."""
    path = new_folder(spark, "adhoc")
    sinks.csv_rows(totalled(spark, sf), path, "place", "stream", "source")
    return spark.read.text(path).where("value not like 'stream,source,%'").select(F.col("value").alias("line"))


QUERIES = {
    "table_totals": over(reports.table_totals),
    "distinct_people": over(reports.distinct_people),
    "event_time_range": over(reports.event_time_range),
    "coverage_by_source": over(reports.coverage_by_source),
    "coverage_by_person": over(reports.coverage_by_person),
    "timeline_daily_counts": over(reports.timeline_daily_counts),
    "person_type_counts": over(reports.person_type_counts),
    "top_types_per_person": over(reports.top_types_per_person),
    "observation_signals": over(reports.observation_signals),
    "source_totals": over(reports.source_totals),
    "run_label": over(reports.run_label),
    "person_summary": over(reports.person_summary),
    "report_summary": over(reports.report_summary),
    "clinical_note": over(reports.clinical_note),
    "all_people": over(lambda ev: ev.where("canonical_person_id is not null").select("canonical_person_id").distinct()),
    "all_events": over(lambda ev: ev),
    "source_bucket": over(lambda ev: ev.select("record_key", source_bucket(F.col("source"), F.col("source_file")).alias("bucket"))),
    "record_type": over(lambda ev: ev.select("record_key", record_type(F.col("stream")).alias("record_type"))),
    "day_bucket": over(lambda ev: ev.select("record_key", F.to_date("event_time").alias("day"))),
    "format_ts": over(lambda ev: ev.select("record_key", format_time(F.col("event_time")).alias("event_time_text"))),
    "csv_cells": over(lambda ev: ev.select("record_key", F.coalesce(format_time(F.col("event_time")), F.lit("")).alias("event_time"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce("code", F.lit("")).alias("code"))),
    "merge_observations": lambda spark, sf: merge_observations(spark, sf),
    "adhoc_sql": adhoc_sql,
    "adhoc_csv": adhoc_csv,
}


def merge_observations(spark, sf):
    """The three sources of observations, each its own projection, united by name."""
    rows = stream_of(spark, sf, "observations")
    parts = [rows.where(F.col("source") == s).select("record_key", "source", "event_time", c) for s, c in (("healthkit", "hk_type"), ("fhir", "resource_type"), ("cda", "code"))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


ORACLE_SQL = {
    name: EVENTS_SQL + sql
    for name, sql in {
        "table_totals": TOTALS,
        "distinct_people": PEOPLE,
        "event_time_range": SPAN,
        "coverage_by_source": BY_SOURCE,
        "coverage_by_person": BY_PERSON,
        "timeline_daily_counts": f"SELECT CAST(date_trunc('day', event_time) AS DATE) AS day, stream, {BUCKET} AS source, COUNT(*) AS rows FROM ev WHERE event_time IS NOT NULL AND {BUCKET} IS NOT NULL GROUP BY 1, 2, 3",
        "person_type_counts": TYPES,
        "top_types_per_person": TOP,
        "observation_signals": SIGNALS,
        "source_totals": SOURCES,
        "run_label": RUN,
        "person_summary": f"SELECT p.*, t.top_types FROM ({BY_PERSON}) p LEFT JOIN (SELECT canonical_person_id, string_agg(type || '=' || rows, ';' ORDER BY rank) AS top_types FROM ({TOP}) GROUP BY 1) t USING (canonical_person_id)",
        "report_summary": SUMMARY,
        "clinical_note": NOTE,
        "all_people": "SELECT DISTINCT canonical_person_id FROM ev WHERE canonical_person_id IS NOT NULL",
        "all_events": "SELECT * FROM ev",
        "source_bucket": f"SELECT record_key, {BUCKET} AS bucket FROM ev",
        "record_type": f"SELECT record_key, {LABEL} AS record_type FROM ev",
        "day_bucket": "SELECT record_key, CAST(event_time AS DATE) AS day FROM ev",
        "format_ts": f"SELECT record_key, strftime(event_time, {STAMP}) AS event_time_text FROM ev",
        "csv_cells": f"SELECT record_key, COALESCE(strftime(event_time, {STAMP}), '') AS event_time, COALESCE(status, '') AS status, COALESCE(code, '') AS code FROM ev",
        "merge_observations": "SELECT record_key, source, event_time, hk_type, resource_type, code FROM ev WHERE stream = 'observations'",
        **{
            name: "".join(f", stream_{s} AS (SELECT * FROM ev WHERE stream = '{s}')" for s in STREAMS) + sql
            for name, sql in {
                "adhoc_sql": f" SELECT * FROM ({JOINED})",
                "adhoc_csv": f" SELECT concat_ws(',', COALESCE(stream, ''), COALESCE(source, ''), n, COALESCE(strftime(latest, {STAMP}), ''), place) AS line FROM ({TOTALLED})",
            }.items()
        },
    }.items()
}
