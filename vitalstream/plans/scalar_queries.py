"""Queries of the column functions and filters over values derived from the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..sources import clinical
from ..sources.tables import table

T, TZ = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


def events(spark, sf, **derived):
    df = table(spark, sf, "events")
    return df.select("*", *[F.expr(sql).alias(name) for name, sql in derived.items()])


def normalize_time(spark, sf):
    raw = f"CASE event_id % 4 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') || ' -0500' WHEN 1 THEN date_format(ts, 'yyyyMMddHHmmss') WHEN 2 THEN {TZ} ELSE 'about ' || event_type END"
    return events(spark, sf, raw=raw).select("event_id", c.normalize_time(F.col("raw")).alias("time"))


def parse_event_time(spark, sf):
    raw = f"CASE event_id % 5 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd') WHEN 1 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") || '+02:00' WHEN 2 THEN date_format(ts, 'yyyyMMdd') WHEN 3 THEN {TZ} ELSE date_format(ts, 'yyyy') END"
    return events(spark, sf, raw=raw).select("event_id", c.parse_time(F.col("raw")).cast("timestamp_ntz").alias("event_time"))


def resources(spark, sf):
    return clinical.resource_rows(clinical.raw_resources(spark, sf)).withColumn("event_id", F.regexp_extract("file", r"(\d+)", 1).cast("long"))


def start_or_end_time(spark, sf):
    df = events(spark, sf, s=f"CASE WHEN event_id % 3 > 0 THEN {TZ} END", e="date_format(ts, 'yyyyMMddHHmmss')")
    return df.select("event_id", F.coalesce(c.normalize_time(F.col("s")), c.normalize_time(F.col("e"))).alias("event_time"))


def redact_path(spark, sf):
    raw = "CASE WHEN event_id % 2 = 0 THEN '/home/' || user_id || '/' || event_type || '.xml' ELSE 'source/' || event_type || '.xml' END"
    return events(spark, sf, raw=raw).select("event_id", c.redact_path(F.col("raw")).alias("path"))


def subject_id(spark, sf):
    raw = "CASE event_id % 3 WHEN 0 THEN 'Patient/u' || user_id WHEN 1 THEN 'Group/' || user_id ELSE 'Patient/' END"
    return events(spark, sf, raw=raw).select("event_id", c.subject_id(F.col("raw")).alias("subject"))


def value_num(spark, sf):
    raw = "CASE event_id % 8 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN ' 7.5 ' WHEN 2 THEN '1e3' WHEN 3 THEN 'true' WHEN 4 THEN '12d' WHEN 5 THEN event_type WHEN 6 THEN '.5' END"
    return events(spark, sf, raw=raw).select("event_id", F.col("raw").alias("value"), c.number(F.col("raw")).alias("value_num"))


def stable_json(spark, sf):
    raw = "CASE event_id % 3 WHEN 0 THEN event_type ELSE '{\"z\": ' || get_json_object(props, '$.k') || ', \"a\": {\"d\": [1, \"' || event_type || '\"], \"c\": null}}' END"
    return events(spark, sf, raw=raw).select("event_id", c.stable_json(F.col("raw")).alias("json"))


def content_key(spark, sf):
    df = events(spark, sf)
    return df.select("event_id", c.content_key("event_type", "props", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user_id")).alias("record_key"))


def key_fallback(spark, sf):
    df = events(spark, sf, rk="CASE event_id % 3 WHEN 0 THEN 'rk' || event_id WHEN 1 THEN '' END", ek="CASE event_id % 2 WHEN 0 THEN 'ek' || event_id END")
    record, event = c.fallback_keys(F.col("rk"), F.col("ek"), F.col("props"))
    return df.select("event_id", record.alias("record_key"), event.alias("event_key"))


def parts(spark, sf):
    name = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '  ' || upper(p_name) || '  ' WHEN 2 THEN split_part(p_name, ' ', 2) || ',  ' || split_part(p_name, ' ', 1) || ' Mid' ELSE split_part(p_name, ' ', 1) END"
    return table(spark, sf, "part").select("p_partkey", "p_name", F.expr(name).alias("name"))


def parse_name(spark, sf):
    return parts(spark, sf).withColumn("n", c.name_parts(F.col("name"))).select("p_partkey", F.col("n.first").alias("first"), F.col("n.last").alias("last"))


def normalize_name(spark, sf):
    return parts(spark, sf).select("p_partkey", c.fold_name(F.concat(F.lit(" Straße  "), F.col("name"))).alias("name"))


def patients(spark, sf):
    return clinical.valid_resources(clinical.raw_resources(spark, sf)).where("kind = 'Patient'")


def id_fingerprint(spark, sf):
    one = patients(spark, sf).select("event_id", F.explode(clinical.patient_ids()).alias("i"))
    return one.select("event_id", c.sha(F.col("i.system")).alias("system_fingerprint"), c.sha(F.col("i.system"), F.col("i.value")).alias("source_patient_id"))


def typed_pick(spark, sf):
    raw = "'{\"v\":' || CASE event_id % 4 WHEN 0 THEN '\"' || event_type || '\"' WHEN 1 THEN CAST(user_id AS STRING) WHEN 2 THEN 'true' ELSE '[1]' END || '}'"
    df = events(spark, sf, raw=raw).withColumn("v", F.variant_get(F.parse_json("raw"), "$.v", "variant"))
    kind = F.schema_of_variant("v")
    return df.select("event_id", F.when(kind == "STRING", F.try_variant_get("v", "$", "string")).alias("as_string"), F.when(kind == "BIGINT", F.try_variant_get("v", "$", "bigint")).alias("as_int"))


def device_mapping(spark, sf):
    """Device rows to observation columns: sample_type, start_time and value_num under their canonical names, with defaults."""
    df = events(spark, sf, sample_type="event_type", start_time=TZ, hk="CASE WHEN event_id % 4 = 0 THEN 'own' END", source_given="CASE WHEN event_id % 2 = 0 THEN 'healthkit' END")
    return df.select("event_id", F.coalesce("hk", "sample_type").alias("hk_type"), c.parse_time(F.col("start_time")).cast("timestamp_ntz").alias("event_time"), F.coalesce("source_given", F.lit("healthkit")).alias("source"), F.lit("ndjson/observations.ndjson").alias("source_file"))


def device_row_key(spark, sf):
    df = events(spark, sf, sample_type="event_type", canonical_person_id="'p' || user_id", schema_version="1", start_time=TZ)
    return df.select("event_id", c.content_key("canonical_person_id", "sample_type", "schema_version", "start_time").alias("record_key"))


def paths(spark, sf):
    """File paths derived from the pages: some exports, some clinical records, some others."""
    p = "CASE page_id % 6 WHEN 0 THEN 'drop/export.xml' WHEN 1 THEN 'drop/Export_CDA.xml' WHEN 2 THEN 'drop/clinical-records/' || page_id || '.JSON' WHEN 3 THEN 'reports/' || page_id || '.csv' WHEN 4 THEN 'staging/../' || page_id ELSE '/abs/note/' || page_id || '.tar.gz' END"
    return table(spark, sf, "pages").select("page_id", F.expr(p).alias("path"), F.octet_length("html").cast("long").alias("size"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), "html")


PATHS = "(SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'drop/export.xml' WHEN 1 THEN 'drop/Export_CDA.xml' WHEN 2 THEN 'drop/clinical-records/' || page_id || '.JSON' WHEN 3 THEN 'reports/' || page_id || '.csv' WHEN 4 THEN 'staging/../' || page_id ELSE '/abs/note/' || page_id || '.tar.gz' END AS path, octet_length(encode(html))::BIGINT AS size, sha256(html) AS sha256, html FROM pages)"


def select_export_members(spark, sf):
    low = F.lower("path")
    clinical_dir = low.rlike(r"(^|/)(clinical-records|clinical_records|clinical/clinical-records|clinical/clinical_records)/")
    return paths(spark, sf).where(low.rlike(r"export\.xml$") | low.rlike(r"export_cda\.xml$") | (clinical_dir & low.endswith(".json"))).select("page_id", "path")


#: The top folders that a share bundle may hold.
SHARED_TOPS = ("reports", "note", "ndjson", "deid")


def allowlist_paths(spark, sf):
    parts_ = F.split("path", "/")
    return paths(spark, sf).where(parts_[0].isin(*SHARED_TOPS) & ~F.array_contains(parts_, "..") & ~F.startswith("path", F.lit("/"))).select("page_id", "path")


def resource_type_sniff(spark, sf):
    """The resource type in the first 64 KiB of a file's text."""
    head = F.substring("text", 1, 65536)
    return clinical.raw_resources(spark, sf).select("event_id", c.blank_to_null(F.regexp_extract(head, r'"resourceType"\s*:\s*"([^"]+)"', 1)).alias("resource_type"))


CODED = "event_id % 7 IN (0, 1, 4)"
CODING_TEXT = "'[{\"system\":\"s1\",\"code\":\"c' || (event_id % 5) || '\"},{\"system\":\"s2\",\"code\":\"' || event_type || '\"}]'"
KIND = "CASE event_id % 7 WHEN 0 THEN 'Observation' WHEN 1 THEN 'Observation' WHEN 2 THEN 'DocumentReference' WHEN 3 THEN 'MedicationRequest' WHEN 4 THEN 'Condition' WHEN 5 THEN 'Patient' END"
FOUR = "event_id % 7 < 5"

QUERIES = {
    "normalize_time": normalize_time,
    "parse_event_time": parse_event_time,
    "fhir_event_time": lambda s, d: resources(s, d).select("event_id", "stream", "event_time"),
    "start_or_end_time": start_or_end_time,
    "redact_path": redact_path,
    "subject_id": subject_id,
    "coding_normalize": lambda s, d: resources(s, d).select("event_id", "code_coding_json", "type_coding_json"),
    "value_quantity": lambda s, d: resources(s, d).where("stream = 'observations'").select("event_id", "value", "unit"),
    "value_num": value_num,
    "stable_json": stable_json,
    "content_key": content_key,
    "key_fallback": key_fallback,
    "parse_name": parse_name,
    "normalize_name": normalize_name,
    "patient_name": lambda s, d: patients(s, d).select("event_id", clinical.patient_name().alias("name")),
    "external_ids": lambda s, d: patients(s, d).select("event_id", F.to_json(clinical.patient_ids()).alias("ids")),
    "id_fingerprint": id_fingerprint,
    "typed_pick": typed_pick,
    "device_mapping": device_mapping,
    "device_row_key": device_row_key,
    "source_id": lambda s, d: resources(s, d).select("event_id", "source_id"),
    "ext_counts": lambda s, d: paths(s, d).groupBy(c.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes")),
    "resource_type_sniff": resource_type_sniff,
    "route_resources": lambda s, d: resources(s, d).select("event_id", "stream"),
    "exclude_patients": lambda s, d: clinical.valid_resources(clinical.raw_resources(s, d)).where("kind <> 'Patient'").select("event_id", "kind"),
    "drop_untyped": lambda s, d: events(s, d, t="CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE event_type END").where("t is not null and t <> ''").select("event_id", F.col("t").alias("hk_type")),
    "sample_first_n": lambda s, d: paths(s, d).orderBy("path", "page_id").limit(200).select("page_id", "path"),
    "top_files": lambda s, d: paths(s, d).orderBy(F.desc("size"), "path", "page_id").limit(10).select("page_id", "path", "size"),
    "select_export_members": select_export_members,
    "allowlist_paths": allowlist_paths,
}

ORACLE_SQL = {
    "normalize_time": f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%SZ') WHEN 3 THEN 'about ' || event_type ELSE {T} END AS time FROM events",
    "parse_event_time": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('day', ts)::TIMESTAMP WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 3 THEN date_trunc('second', ts) END AS event_time FROM events",
    "fhir_event_time": f"SELECT event_id, CASE event_id % 7 WHEN 2 THEN 'documents' WHEN 3 THEN 'medications' WHEN 4 THEN 'conditions' ELSE 'observations' END AS stream, {T} AS event_time FROM events WHERE {FOUR}",
    "start_or_end_time": f"SELECT event_id, {T} AS event_time FROM events",
    "redact_path": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || '.xml' ELSE 'source/' || event_type || '.xml' END AS path FROM events",
    "subject_id": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'u' || user_id END AS subject FROM events",
    "coding_normalize": f"SELECT event_id, CASE WHEN {CODED} THEN {CODING_TEXT} END AS code_coding_json, CASE WHEN event_id % 7 = 2 THEN {CODING_TEXT} END AS type_coding_json FROM events WHERE {FOUR}",
    "value_quantity": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN (event_id % 100)::VARCHAR END AS value, CASE WHEN event_id % 7 = 0 THEN 'bpm' END AS unit FROM events WHERE event_id % 7 < 2",
    "value_num": "SELECT event_id, CASE event_id % 8 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN ' 7.5 ' WHEN 2 THEN '1e3' WHEN 3 THEN 'true' WHEN 4 THEN '12d' WHEN 5 THEN event_type WHEN 6 THEN '.5' END AS value, CASE event_id % 8 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN 7.5 WHEN 2 THEN 1000 WHEN 3 THEN 1 WHEN 6 THEN 0.5 END::DOUBLE AS value_num FROM events",
    "stable_json": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type ELSE '{\"a\":{\"c\":null,\"d\":[1,\"' || event_type || '\"]},\"z\":' || json_extract_string(props, '$.k') || '}' END AS json FROM events",
    "content_key": "SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"props\":\"' || replace(props, '\"', '\\\"') || '\",\"user_id\":' || CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR ELSE 'null' END || '}') AS record_key FROM events",
    "key_fallback": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'rk' || event_id WHEN event_id % 2 = 0 THEN 'ek' || event_id ELSE sha256(props) END AS record_key, CASE WHEN event_id % 2 = 0 THEN 'ek' || event_id WHEN event_id % 3 = 0 THEN 'rk' || event_id ELSE sha256(props) END AS event_key FROM events",
    "parse_name": "SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL WHEN 1 THEN upper(split_part(p_name, ' ', 1)) ELSE split_part(p_name, ' ', 1) END AS first, CASE p_partkey % 4 WHEN 3 THEN NULL WHEN 1 THEN upper(split_part(p_name, ' ', 2)) ELSE split_part(p_name, ' ', 2) END AS last FROM part",
    "normalize_name": "SELECT p_partkey, 'strasse ' || CASE p_partkey % 4 WHEN 2 THEN split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) || ' mid' WHEN 3 THEN split_part(p_name, ' ', 1) ELSE p_name END AS name FROM part",
    "patient_name": "SELECT event_id, 'Ann' || (user_id % 40) || ' Lee' || (user_id % 7) AS name FROM events WHERE event_id % 7 = 5",
    "external_ids": "SELECT event_id, '[{\"system\":\"fhir:id\",\"value\":\"u' || user_id || '\"},{\"system\":\"mrn\",\"value\":\"m' || (user_id % 60) || '\"}]' AS ids FROM events WHERE event_id % 7 = 5",
    "id_fingerprint": "SELECT event_id, sha256('fhir:id') AS system_fingerprint, sha256('fhir:id:u' || user_id) AS source_patient_id FROM events WHERE event_id % 7 = 5 UNION ALL SELECT event_id, sha256('mrn'), sha256('mrn:m' || (user_id % 60)) FROM events WHERE event_id % 7 = 5",
    "typed_pick": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type END AS as_string, CASE WHEN event_id % 4 = 1 THEN user_id END AS as_int FROM events",
    "device_mapping": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'own' ELSE event_type END AS hk_type, date_trunc('second', ts) AS event_time, 'healthkit' AS source, 'ndjson/observations.ndjson' AS source_file FROM events",
    "device_row_key": f"SELECT event_id, sha256('{{\"canonical_person_id\":\"p' || user_id || '\",\"sample_type\":\"' || event_type || '\",\"schema_version\":1,\"start_time\":\"' || {T} || '\"}}') AS record_key FROM events",
    "source_id": f"SELECT event_id, {KIND} || '/r' || event_id AS source_id FROM events WHERE {FOUR}",
    "ext_counts": f"SELECT lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS ext, COUNT(*) AS files, SUM(size)::BIGINT AS bytes FROM {PATHS} GROUP BY 1",
    "resource_type_sniff": f"SELECT event_id, {KIND} AS resource_type FROM events",
    "route_resources": f"SELECT event_id, CASE event_id % 7 WHEN 2 THEN 'documents' WHEN 3 THEN 'medications' WHEN 4 THEN 'conditions' ELSE 'observations' END AS stream FROM events WHERE {FOUR}",
    "exclude_patients": f"SELECT event_id, {KIND} AS kind FROM events WHERE {FOUR}",
    "drop_untyped": "SELECT event_id, event_type AS hk_type FROM events WHERE event_id % 4 > 1",
    "sample_first_n": f"SELECT page_id, path FROM {PATHS} ORDER BY path, page_id LIMIT 200",
    "top_files": f"SELECT page_id, path, size FROM {PATHS} ORDER BY size DESC, path, page_id LIMIT 10",
    "select_export_members": f"SELECT page_id, path FROM {PATHS} WHERE page_id % 6 < 3",
    "allowlist_paths": f"SELECT page_id, path FROM {PATHS} WHERE page_id % 6 = 3",
}
