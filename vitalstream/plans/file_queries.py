"""Queries of file sources, sinks and streams. The files are derived from the tables by Spark, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from ..sources import canonical, clinical, files, markup, sinks
from ..sources.tables import EVENTS_SQL, STREAMS, all_events, drop_folder, new_folder, shuffles_dropped, spread, table
from ..streaming import loads

STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"
T = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"


def lines_of(spark, sf, sql, name="events", folder="lines"):
    """A folder with the text that sql makes of each row of a table."""
    path = new_folder(spark, folder)
    table(spark, sf, name).select(F.expr(sql).alias("value")).write.text(path)
    return path


def device_exports(spark, sf):
    """A device export for each of 64 groups of persons."""
    record = (
        "concat('<Record type=\"', CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END, '\" unit=\"u', u, '\" value=\"', event_id, '\"', "
        "CASE WHEN event_id % 2 = 0 THEN concat(' startDate=\"', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' -0500\"') ELSE '' END, ' endDate=\"', date_format(ts, 'yyyyMMddHHmmss'), '\"/>')"
    )
    path = new_folder(spark, "exports")
    ev = table(spark, sf, "events")
    ev = ev.withColumn("u", F.col("user_id")).withColumn("user_id", F.col("user_id") % 64)
    users = ev.select("user_id").distinct()
    ends = [users.select("user_id", F.lit(n).alias("n"), F.lit(tag).alias("value")) for n, tag in ((0, "<HealthData>"), (2, "</HealthData>"))]
    lines = ev.select("user_id", F.lit(1).alias("n"), F.expr(record).alias("value")).unionByName(ends[0]).unionByName(ends[1])
    # An export file for each group of persons, its lines written one by one.
    spread(lines, "user_id").sortWithinPartitions("user_id", "n").select("user_id", "value").write.partitionBy("user_id").text(path)
    return path


def scan_healthkit_records(spark, sf):
    return files.healthkit_records(spark, device_exports(spark, sf)).drop("record_key")


def scan_fhir_resources(spark, sf):
    path = lines_of(spark, sf, clinical.RESOURCE)
    return clinical.resource_rows(spark.read.text(path).select(F.lit("clinical.json").alias("file"), F.col("value").alias("text"))).drop("file")


PRETTY = "concat('{\n  \"resourceType\": \"Condition\",\n  \"id\": \"s', s_suppkey, '\",\n  \"subject\": {\n    \"reference\": \"Patient/u', s_nationkey, '\"\n  },\n  \"recordedDate\": \"2020-01-01T00:00:00Z\",\n  \"code\": {\n    \"coding\": [\n      {\"system\": \"s\", \"code\": \"c', s_nationkey, '\"}\n    ]\n  }\n}')"


def scan_fhir_files(spark, sf):
    """Pretty-printed resources, one a file, read whole; every seventh file is cut."""
    root = new_folder(spark, "clinical")
    text = F.expr(f"CASE WHEN s_suppkey % 7 = 0 THEN substring({PRETTY}, 1, 40) ELSE {PRETTY} END")
    rows = table(spark, sf, "supplier").select("s_suppkey", F.posexplode(F.split(text, "\n")).alias("n", "value"))
    spread(rows, "s_suppkey").sortWithinPartitions("s_suppkey", "n").select("s_suppkey", "value").write.partitionBy("s_suppkey").text(root)
    return clinical.resource_rows(clinical.resource_files(spark, root)).drop("file")


_ONE = "concat('<observation>', chr(10), '<code code=\"c', event_id % 9, '\"/><effectiveTime value=\"', date_format(ts, 'yyyyMMddHHmmss'), '\"/><value value=\"', event_id, '\" unit=\"mg\"/>', chr(10), '<entryRelationship><observation><code code=\"inner\"/></observation></entryRelationship></observation>')"


def cda_folder(spark, sf):
    """Clinical documents of many lines, one file for each 200 events."""
    root = new_folder(spark, "cda")
    ev = spread(table(spark, sf, "events").select(F.expr("event_id div 200").alias("k"), "event_id", "ts"), "k")
    one = F.array_sort(F.collect_list(F.struct("event_id", F.expr(_ONE).alias("value"))))
    lines = F.concat(F.array(F.lit('<ClinicalDocument xmlns="urn:x">')), F.transform("lines", lambda x: x["value"]), F.array(F.lit("</ClinicalDocument>")))
    # A document is a row and a row a file, so that the files need no folder each.
    ev.groupBy("k").agg(one.alias("lines")).select(F.array_join(lines, "\n").alias("value")).write.option("maxRecordsPerFile", 1).text(root)
    return root


def scan_cda_observations(spark, sf):
    return files.cda_observations(files.cda_documents(spark, cda_folder(spark, sf))).drop("file")


def scan_cda_ranges(spark, sf):
    """The same documents, each read range by range, as those are that are too large for a cell."""
    return markup.all_cda_observations(spark, cda_folder(spark, sf), one_cell=0).drop("file")


def tag_counts_files(spark, sf):
    """Start tags in raw files, which Spark cuts into byte ranges."""
    return markup.start_tags(markup.pieces(spark, staged(spark, sf)))


def raw_exports(spark, sf):
    """A raw export of device records for each of 16 groups of persons."""
    path = new_folder(spark, "raw")
    ev = table(spark, sf, "events").select((F.col("user_id") % 16).alias("k"), "event_id", F.expr(_RAW).alias("value"))
    spread(ev, "k").sortWithinPartitions("k", "event_id").select("k", "value").write.partitionBy("k").text(path)
    return path


_RAW = "concat('<Record type=\"HK', event_type, '\" unit=\"x\"/>', CASE WHEN event_id % 3 = 0 THEN concat('<Workout type=\"w\"/><Record', chr(10), ' type=\"HKOther\"/>') ELSE '<record/> type=\"x\"' END)"


def hk_type_counts_files(spark, sf):
    return markup.record_types(markup.pieces(spark, raw_exports(spark, sf)))


def record_estimate_files(spark, sf):
    """Estimated records and line ends of each raw export, unparsed."""
    return markup.record_estimates(markup.pieces(spark, raw_exports(spark, sf)), folder_no("file"))


_ROW = (
    "CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN '[1, 2]' ELSE concat('{\"schema_version\": 2, \"record_key\": \"', CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('k', event_id) END, "
    "'\", \"event_key\": \"e', event_id, '\", \"canonical_person_id\": \"p', user_id, '\", \"source\": \"healthkit\", \"event_time\": \"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), "
    "'\", \"hk_type\": \"', event_type, '\", \"value\": ', CASE WHEN event_id % 3 = 0 THEN '\"text\"' ELSE CAST(event_id AS STRING) END, ', \"pii_name\": \"x\", \"unit\": 5}') END"
)


def scan_ndjson(spark, sf):
    rows = files.observation_rows(files.json_lines(spark, lines_of(spark, sf, _ROW)))
    return rows.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


def scan_device_drop(spark, sf):
    root = new_folder(spark, "device")
    ev = table(spark, sf, "events")
    line = "concat('{\"schema_version\":1,\"record_key\":\"d', event_id, '\",\"source\":\"healthkit\",\"sample_type\":\"', event_type, '\",\"start_time\":\"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), '\",\"value_num\":', event_id, '.5,\"run_id\":\"own\"}')"
    ev.select((F.col("user_id") % 4).alias("drop"), F.expr(line).alias("value")).write.partitionBy("drop").text(f"{root}/drops")
    ev.select((F.col("user_id") % 4).cast("string").alias("drop")).distinct().select("drop", F.concat(F.lit("run-"), "drop").alias("run_id")).write.json(f"{root}/manifests")
    return files.device_drops(spark, root).select("record_key", "run_id", "source_file", "hk_type", "value", "value_num", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


def resolve_layout(spark, sf):
    path = "CASE page_id % 5 WHEN 0 THEN 'export.xml' WHEN 1 THEN 'clinical/clinical-records/' || page_id || '.json' WHEN 2 THEN 'apple_health_export/export.xml' WHEN 3 THEN 'export_cda.xml' ELSE 'apple_health_export/clinical_records/' || page_id || '.json' END"
    return files.layouts(table(spark, sf, "pages").select(F.expr("'d' || (page_id div 7)").alias("drop"), F.expr(path).alias("path")))


def staged(spark, sf):
    """All pages as files, 64 pages a file."""
    root = new_folder(spark, "staged")
    pages = table(spark, sf, "pages").select(F.expr("page_id div 64").alias("k"), "page_id", F.col("html").alias("value"))
    spread(pages, "k").sortWithinPartitions("k", "page_id").select("k", "value").write.partitionBy("k").text(root)
    return root


def folder_no(path="path"):
    return F.regexp_extract(path, "/k=(\\d+)/", 1).cast("long").alias("k")


def export_ndjson_lines(spark, sf):
    """The canonical lines of all streams, each from its own output."""
    path = new_folder(spark, "ndjson")
    sinks.canonical_lines(all_events(spark, sf), path)
    parts = [spark.read.text(f"{path}/{s}").select(F.lit(s).alias("stream"), F.col("value").alias("line")) for s in STREAMS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def canonical_export(spark, sf):
    """The canonical lines of device records, clinical resources and clinical documents, all keys of theirs, read back. The raw
    files of a source and all shuffle files go once its lines have been put by; the export is gzipped."""
    path = new_folder(spark, "canonical")
    people = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.lit("fhir:id").alias("system"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("value"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("person"))

    def sources():
        raw = device_exports(spark, sf)
        yield canonical.device_lines(files.healthkit_records(spark, raw), "source/export.xml", "run1")
        drop_folder(spark, raw)
        raw = cda_folder(spark, sf)
        yield canonical.document_lines(files.cda_observations(files.cda_documents(spark, raw)), "source/export_cda.xml", "run1")
        drop_folder(spark, raw)
        yield canonical.resource_lines(clinical.raw_resources(spark, sf).select("file", "text"), people, "run1")

    with shuffles_dropped(spark):
        canonical.export(sources(), path, "gzip")
    return spark.read.schema("value string, stream string").text(path).select("stream", F.col("value").alias("line"))


def export_device_lines(spark, sf):
    """Device rows as lines sorted by key, read back."""
    path = new_folder(spark, "device")
    rows = table(spark, sf, "events").select(F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("record_key"), F.col("event_type").alias("sample_type"), F.date_trunc("second", "ts").alias("start_time"), F.col("value").alias("value_num"))
    sinks.device_lines(rows, path)
    return spark.read.text(path).select(F.get_json_object("value", "$.record_key").alias("record_key"), F.col("value").alias("line"))


def csv_result(spark, sf):
    """A query result as CSV and read back as text: header, quotes, empty cells and times."""
    path = new_folder(spark, "csv")
    ev = all_events(spark, sf).select("record_key", "event_time", "status", F.concat_ws(",", "stream", "code").alias("label"))
    sinks.csv_rows(ev, path, "record_key")
    return spark.read.text(path).where("value not like 'record_key,event_time%'").select(F.col("value").alias("line"))


def report_sinks(spark, sf):
    """Reports written as files, their lines read back."""
    ev, path = all_events(spark, sf), new_folder(spark, "reports")
    sinks.report_files({"totals": (reports.table_totals(ev), ("stream",)), "people": (reports.distinct_people(ev), ("stream",)), "days": (reports.timeline_daily_counts(ev), ("day", "stream", "source"))}, path)
    back = [spark.read.text(f"{path}/{kind}/{name}").select(F.lit(kind).alias("kind"), F.lit(name).alias("report"), F.col("value").alias("line")) for kind in ("csv", "json") for name in ("totals", "people", "days")]
    out = back[0]
    for b in back[1:]:
        out = out.unionByName(b)
    return out.distinct()


def load_tables(spark, sf):
    """A table per stream, created if absent; run1 is appended, and run0 once more, which adds nothing."""
    path = new_folder(spark, "tables")
    for run in ("run0", "run1", "run0"):
        loads.load_streams(all_events(spark, sf).where(F.col("run_id") == run), path)
    return loads.loaded_streams(spark, path)


def partitioned_events(spark, sf):
    """Upsert and delete events by stream, month and person group, sorted by person, day and type, gzipped; what is left after
    the deletes, by day and stream. Every fifth record is deleted by a later event.

    A folder per person, type and day would be millions of small files, so those are kept together by sorting.
    """
    path = new_folder(spark, "partitioned")
    kind = F.coalesce("hk_type", "code", "resource_type", F.lit("none"))
    rows = all_events(spark, sf).select("record_key", "canonical_person_id", "stream", kind.alias("record_type"), F.to_date("event_time").cast("string").alias("day"))
    ops = rows.withColumn("op", F.lit("upsert")).withColumn("seq", F.lit(1))
    ops = ops.unionByName(rows.where("cast(regexp_extract(record_key, '(\\\\d+)$', 1) as bigint) % 5 = 0").withColumn("op", F.lit("delete")).withColumn("seq", F.lit(2)))
    sinks.event_stream(ops, path)
    current = sinks.current_events(sinks.stream_events(spark, path))
    return current.groupBy(F.coalesce("day", F.lit("none")).alias("day"), "stream").agg(F.count("*").alias("rows"), F.count_distinct("canonical_person_id").alias("people"))


def drops(spark, sf):
    """Device drops as JSON lines: every fourth row comes twice, under one key."""
    path = new_folder(spark, "drops")
    ev = table(spark, sf, "events").select(F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("record_key"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("canonical_person_id"), F.date_trunc("second", "ts").cast("timestamp").alias("event_time"), "value")
    ev.unionByName(ev.where("cast(substring(record_key, 2) as bigint) % 4 = 0")).write.option("timestampFormat", STAMP).json(path)
    return path


def stream_incremental(spark, sf):
    """Two runs over the same drops: the second finds nothing new."""
    path, sink, checkpoint = drops(spark, sf), new_folder(spark, "sink"), new_folder(spark, "cursor")
    loads.incremental(spark, path, sink, checkpoint)
    loads.incremental(spark, path, sink, checkpoint)
    return spark.read.schema(loads.DROP).parquet(sink).groupBy("canonical_person_id").agg(F.count("*").alias("rows"))


def stream_append_if_absent(spark, sf):
    path, tables, checkpoint = drops(spark, sf), new_folder(spark, "table"), new_folder(spark, "cursor")
    loads.replay_safe(spark, path, tables, checkpoint, files_per_batch=4)
    return spark.read.parquet(tables).select("record_key", "canonical_person_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


def stream_daily_counts(spark, sf):
    """Counts of two runs over the same drops: the second finds nothing new and gives the same table."""
    path, days, cursor = drops(spark, sf), new_folder(spark, "days"), new_folder(spark, "cursor")
    loads.daily_counts(spark, path, days, cursor)
    return loads.daily_counts(spark, path, days, cursor)


CODING_TEXT = "'[{\"system\":\"s1\",\"code\":\"c' || (event_id % 5) || '\"},{\"system\":\"s2\",\"code\":\"' || event_type || '\"}]'"
KIND = "CASE event_id % 7 WHEN 0 THEN 'Observation' WHEN 1 THEN 'Observation' WHEN 2 THEN 'DocumentReference' WHEN 3 THEN 'MedicationRequest' WHEN 4 THEN 'Condition' END"

QUERIES = {
    "scan_healthkit_records": scan_healthkit_records,
    "scan_fhir_resources": scan_fhir_resources,
    "scan_cda_observations": scan_cda_observations,
    "scan_ndjson": scan_ndjson,
    "scan_device_drop": scan_device_drop,
    "resolve_layout": resolve_layout,
    "file_inventory": lambda s, d: files.inventory(s, staged(s, d)).select(folder_no(), "length"),
    "staging_manifest": lambda s, d: files.manifest(s, staged(s, d)).select(folder_no(), "size", "sha256"),
    "export_ndjson_lines": export_ndjson_lines,
    "canonical_export": canonical_export,
    "export_device_lines": export_device_lines,
    "csv_result": csv_result,
    "report_sinks": report_sinks,
    "scan_fhir_files": scan_fhir_files,
    "load_tables": load_tables,
    "partitioned_events": partitioned_events,
    "stream_incremental": stream_incremental,
    "stream_append_if_absent": stream_append_if_absent,
    "stream_daily_counts": stream_daily_counts,
    "scan_cda_ranges": scan_cda_ranges,
    "tag_counts_files": tag_counts_files,
    "hk_type_counts_files": hk_type_counts_files,
    "record_estimate_files": record_estimate_files,
}

STAGED = "(SELECT page_id // 64 AS k, string_agg(html || chr(10), '' ORDER BY page_id) AS content FROM pages GROUP BY 1)"
_LINE = "'{\"canonical_person_id\":\"' || canonical_person_id || '\",\"code\":' || COALESCE('\"' || code || '\"', 'null') || ',\"event_time\":' || COALESCE('\"' || strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') || '\"', 'null') || ',\"hk_type\":' || COALESCE('\"' || hk_type || '\"', 'null') || ',\"record_key\":\"' || record_key || '\",\"resource_type\":' || COALESCE('\"' || resource_type || '\"', 'null') || ',\"run_id\":\"' || run_id || '\",\"source\":\"' || source || '\",\"source_file\":\"' || source_file || '\",\"status\":' || COALESCE('\"' || status || '\"', 'null') || '}'"
_DAYS = "SELECT CAST(date_trunc('day', event_time) AS DATE) AS day, stream, CASE WHEN source_file LIKE 'ndjson/%' THEN 'ios' ELSE source END AS source, COUNT(*) AS n FROM ev WHERE event_time IS NOT NULL GROUP BY 1, 2, 3"
ORACLE_SQL = {
    "scan_healthkit_records": f"SELECT CASE WHEN event_id % 2 = 0 THEN strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%SZ') ELSE {T} END AS event_time, event_type AS hk_type, 'u' || user_id AS unit, event_id::VARCHAR AS value FROM events WHERE event_id % 5 <> 0",
    "scan_fhir_resources": f"SELECT CASE event_id % 7 WHEN 2 THEN 'documents' WHEN 3 THEN 'medications' WHEN 4 THEN 'conditions' ELSE 'observations' END AS stream, {KIND} || '/r' || event_id AS source_id, 'u' || user_id AS subject, {T} AS event_time, CASE WHEN event_id % 7 IN (0, 1, 4) THEN {CODING_TEXT} END AS code_coding_json, CASE WHEN event_id % 7 = 2 THEN {CODING_TEXT} END AS type_coding_json, CASE WHEN event_id % 7 = 0 THEN (event_id % 100)::VARCHAR END AS value, CASE WHEN event_id % 7 = 0 THEN 'bpm' END AS unit, CASE event_id % 7 WHEN 0 THEN 'final' WHEN 2 THEN 'current' WHEN 3 THEN 'active' END AS status FROM events WHERE event_id % 7 < 5",
    "scan_cda_observations": f"SELECT {T} AS event_time, 'c' || (event_id % 9) AS code, event_id::VARCHAR AS value, 'mg' AS unit FROM events UNION ALL SELECT NULL, 'inner', NULL, NULL FROM events",
    "scan_ndjson": "SELECT 2 AS schema_version, CASE WHEN event_id % 4 = 0 THEN 'e' ELSE 'k' END || event_id AS record_key, 'e' || event_id AS event_key, 'p' || user_id AS canonical_person_id, 'healthkit' AS source, 'ndjson/observations.ndjson' AS source_file, date_trunc('second', ts) AS event_time, NULL::VARCHAR AS run_id, event_type AS hk_type, CASE WHEN event_id % 3 = 0 THEN 'text' ELSE event_id::VARCHAR END AS value, CASE WHEN event_id % 3 <> 0 THEN event_id::DOUBLE END AS value_num, NULL::VARCHAR AS unit FROM events WHERE event_id % 10 > 1",
    "scan_device_drop": "SELECT 'd' || event_id AS record_key, 'run-' || (user_id % 4) AS run_id, 'ndjson/observations.ndjson' AS source_file, event_type AS hk_type, event_id || '.5' AS value, event_id + 0.5::DOUBLE AS value_num, date_trunc('second', ts) AS event_time FROM events",
    "resolve_layout": "WITH l AS (SELECT 'd' || (page_id // 7) AS drop, page_id % 5 AS k FROM pages), m AS (SELECT drop, MIN(k) AS root FROM l WHERE k IN (0, 2) GROUP BY 1) SELECT m.drop, CASE root WHEN 0 THEN '.' ELSE 'apple_health_export' END AS root, 'export.xml' AS export, MAX(CASE WHEN root = 0 AND k = 3 THEN 'export_cda.xml' END) AS cda, MAX(CASE WHEN root = 0 AND k = 1 THEN 'clinical/clinical-records' WHEN root = 2 AND k = 4 THEN 'clinical_records' END) AS clinical_dir FROM m JOIN l ON l.drop = m.drop GROUP BY 1, 2",
    "file_inventory": f"SELECT k, octet_length(encode(content))::BIGINT AS length FROM {STAGED}",
    "staging_manifest": f"SELECT k, octet_length(encode(content))::BIGINT AS size, sha256(content) AS sha256 FROM {STAGED}",
    "export_ndjson_lines": EVENTS_SQL + f"SELECT stream, {_LINE} AS line FROM ev",
    "export_device_lines": "SELECT 'd' || event_id AS record_key, '{\"record_key\":\"d' || event_id || '\",\"sample_type\":\"' || event_type || '\",\"start_time\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '\",\"value_num\":' || value || '}' AS line FROM events",
    "csv_result": EVENTS_SQL + "SELECT record_key || ',' || COALESCE(strftime(event_time, '%Y-%m-%dT%H:%M:%SZ'), '') || ',' || COALESCE(status, '') || ',' || CASE WHEN code IS NULL THEN stream ELSE '\"' || stream || ',' || code || '\"' END AS line FROM ev",
    "report_sinks": EVENTS_SQL + f", t AS (SELECT s.stream, COUNT(ev.stream) AS n FROM (VALUES ('observations'), ('documents'), ('medications'), ('conditions')) s(stream) LEFT JOIN ev ON ev.stream = s.stream GROUP BY 1), p AS (SELECT stream, COUNT(DISTINCT canonical_person_id) AS n FROM ev GROUP BY 1 UNION ALL SELECT 'all', COUNT(DISTINCT canonical_person_id) FROM ev), d AS ({_DAYS}) SELECT 'csv' AS kind, 'totals' AS report, 'stream,rows' AS line UNION ALL SELECT 'csv', 'totals', stream || ',' || n FROM t UNION ALL SELECT 'csv', 'people', 'stream,people' UNION ALL SELECT 'csv', 'people', stream || ',' || n FROM p UNION ALL SELECT 'csv', 'days', 'day,stream,source,rows' UNION ALL SELECT 'csv', 'days', day || ',' || stream || ',' || source || ',' || n FROM d UNION ALL SELECT 'json', 'totals', '{{\"rows\":' || n || ',\"stream\":\"' || stream || '\"}}' FROM t UNION ALL SELECT 'json', 'people', '{{\"people\":' || n || ',\"stream\":\"' || stream || '\"}}' FROM p UNION ALL SELECT 'json', 'days', '{{\"day\":\"' || day || '\",\"rows\":' || n || ',\"source\":\"' || source || '\",\"stream\":\"' || stream || '\"}}' FROM d",
    "scan_fhir_files": "SELECT 'conditions' AS stream, 'Condition/s' || s_suppkey AS source_id, 'u' || s_nationkey AS subject, '2020-01-01T00:00:00Z' AS event_time, '[{\"system\":\"s\",\"code\":\"c' || s_nationkey || '\"}]' AS code_coding_json, NULL::VARCHAR AS type_coding_json, NULL::VARCHAR AS value, NULL::VARCHAR AS unit, NULL::VARCHAR AS status FROM supplier WHERE s_suppkey % 7 <> 0",
    "load_tables": EVENTS_SQL + "SELECT * FROM ev",
    "partitioned_events": EVENTS_SQL + "SELECT COALESCE(CAST(event_time AS DATE)::VARCHAR, 'none') AS day, stream, COUNT(*) AS rows, COUNT(DISTINCT canonical_person_id) AS people FROM ev WHERE regexp_extract(record_key, '([0-9]+)$', 1)::BIGINT % 5 <> 0 GROUP BY 1, 2",
    "stream_incremental": "SELECT 'p' || user_id AS canonical_person_id, COUNT(*) + COUNT(*) FILTER (event_id % 4 = 0) AS rows FROM events GROUP BY 1",
    "stream_append_if_absent": "SELECT 'k' || event_id AS record_key, 'p' || user_id AS canonical_person_id, date_trunc('second', ts) AS event_time FROM events",
    "stream_daily_counts": "SELECT CAST(ts AS DATE) AS day, COUNT(*) + COUNT(*) FILTER (event_id % 4 = 0) AS rows FROM events GROUP BY 1",
    "tag_counts_files": "SELECT regexp_replace(t, '^[^:]*:', '') AS tag, COUNT(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<\\s*([A-Za-z_][A-Za-z0-9_.:-]*)', 1)) AS t FROM pages) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "hk_type_counts_files": "SELECT 'HK' || event_type AS hk_type, COUNT(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'HKOther', COUNT(*) FROM events WHERE event_id % 3 = 0",
    "record_estimate_files": "SELECT user_id % 16 AS k, (COUNT(*) + COUNT(*) FILTER (event_id % 3 = 0))::BIGINT AS records, (COUNT(*) + COUNT(*) FILTER (event_id % 3 = 0))::BIGINT AS newlines FROM events GROUP BY 1",
}
_TIMED = "',\"event_time\":' || COALESCE('\"' || t || '\"', 'null')"
_RUN = "'\"run_id\":\"run1\",\"schema_version\":2,\"source\":\"'"
#: The members before event_key, between it and record_key, and after it, of each source's rows.
_PARTS = f"""SELECT 'observations' AS stream, '"canonical_person_id":"unresolved"' AS head, substr({_TIMED}, 2) || ',"hk_type":"' || event_type || '"' AS middle,
 {_RUN} || 'healthkit","source_file":"source/export.xml","unit":"u' || user_id || '","value":"' || event_id || '"' AS tail
 FROM (SELECT *, strftime(ts + (CASE WHEN event_id % 2 = 0 THEN 5 ELSE 0 END) * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS t FROM events WHERE event_id % 5 <> 0)
UNION ALL SELECT DISTINCT 'observations', '"canonical_person_id":"unresolved","code":"' || code || '"', substr({_TIMED}, 2),
 {_RUN} || 'cda","source_file":"source/export_cda.xml","unit":' || COALESCE('"' || unit || '"', 'null') || ',"value":' || COALESCE('"' || value || '"', 'null')
 FROM (SELECT {T} AS t, 'c' || (event_id % 9) AS code, 'mg' AS unit, event_id::VARCHAR AS value FROM events UNION ALL SELECT NULL, 'inner', NULL, NULL FROM events)
UNION ALL SELECT CASE k WHEN 2 THEN 'documents' WHEN 3 THEN 'medications' WHEN 4 THEN 'conditions' ELSE 'observations' END,
 '"canonical_person_id":"' || COALESCE('p' || c_custkey, 'unresolved') || '"' || CASE WHEN k IN (0, 1, 4) THEN ',"code_coding":' || coded ELSE '' END, substr({_TIMED}, 2),
 '"resource_type":"' || kind || '",' || {_RUN} || 'fhir","source_file":"clinical-records/' || event_id || '.json","source_id":"' || kind || '/r' || event_id || '"'
 || CASE k WHEN 0 THEN ',"status":"final"' WHEN 2 THEN ',"status":"current"' WHEN 3 THEN ',"status":"active"' ELSE '' END || CASE WHEN k = 2 THEN ',"type_coding":' || coded ELSE '' END
 || CASE WHEN k = 0 THEN ',"unit":"bpm","value":' || (event_id % 100) ELSE '' END
 FROM (SELECT *, event_id % 7 AS k, {KIND} AS kind, {T} AS t, '[{{"code":"c' || (event_id % 5) || '","system":"s1"}},{{"code":"' || event_type || '","system":"s2"}}]' AS coded FROM events WHERE event_id % 7 < 5) e
 LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_custkey % 3 <> 0"""
ORACLE_SQL["canonical_export"] = (
    f"SELECT stream, '{{' || head || ',\"event_key\":\"' || h || '\",' || middle || ',\"record_key\":\"' || h || '\",' || tail || '}}' AS line "
    f"FROM (SELECT *, sha256('{{' || head || ',' || middle || ',' || tail || '}}') AS h FROM ({_PARTS}))"
)
ORACLE_SQL["scan_cda_ranges"] = ORACLE_SQL["scan_cda_observations"]
