"""Queries of validation, privacy, identity and document profiles, and their SQL."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.columns import fold_name
from ..operators import identity, keyed, privacy, quality
from ..sources import clinical, files
from ..sources.tables import new_folder, spread, table, written
from .keyed_queries import HITS, hits

# ---- validation of lines that are broken by formula

_FULL = (
    "concat('{\"canonical_person_id\":\"p', user_id, '\",\"source\":\"healthkit\",\"source_file\":\"', event_type, '.xml\",\"event_time\":', "
    "CASE WHEN event_id % 9 = 8 THEN 'null' ELSE '\"2024-01-01T00:00:00Z\"' END, CASE WHEN event_id % 9 = 1 THEN '' ELSE ',\"run_id\":\"r1\"' END, "
    "',\"record_key\":\"e', event_id, '\"', CASE event_id % 9 WHEN 7 THEN '' WHEN 5 THEN ',\"schema_version\":\"2\"' ELSE ',\"schema_version\":2' END, '}')"
)
_LINE = f"CASE event_id % 9 WHEN 2 THEN concat(' ', chr(9)) WHEN 3 THEN concat('{{\"cut\": ', event_id) WHEN 4 THEN concat('[', user_id, ']') ELSE {_FULL} END"
TOKENS, PATTERNS = ["purchase", "signup"], ["p1[0-9]\\b"]


def lines(spark, sf):
    return table(spark, sf, "events").select(F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string"), F.lit(".ndjson")).alias("file"), F.col("event_id").alias("line_no"), F.expr(_LINE).alias("line"))


L = f"(SELECT 'f' || (user_id % 5) || '.ndjson' AS file, event_id AS line_no, {_LINE} AS line, event_id FROM events)"
EMPTY = f"SELECT file, line_no, 'empty_line' AS code, '' AS detail FROM {L} WHERE regexp_full_match(line, '\\s*')"
BANNED = " UNION ALL ".join(
    [f"SELECT file, line_no, 'banned_token' AS code, '{t}' AS detail FROM {L} WHERE contains(line, '{t}')" for t in TOKENS]
    + [f"SELECT file, line_no, 'banned_pattern', '{p}' FROM {L} WHERE regexp_matches(line, '{p}')" for p in PATTERNS]
)
JSON = f"SELECT file, line_no, CASE WHEN NOT json_valid(line) THEN 'invalid_json' ELSE 'not_object' END AS code, '' AS detail FROM {L} WHERE NOT regexp_full_match(line, '\\s*') AND (NOT json_valid(line) OR json_type(line) <> 'OBJECT')"
_KEYS = ", ".join(f"'{k}'" for k in quality.REQUIRED)
_TYPED = f"(SELECT file, line_no, key, json_type(line, '$.' || key) AS kind FROM (SELECT * FROM {L} WHERE json_valid(line)) , (SELECT unnest([{_KEYS}]) AS key) WHERE json_type(line) = 'OBJECT')"
KEYS = f"SELECT file, line_no, CASE WHEN kind IS NULL THEN 'missing_required_key' ELSE 'invalid_type' END AS code, key AS detail FROM {_TYPED} WHERE kind IS NULL OR CASE key WHEN 'schema_version' THEN kind NOT IN ('BIGINT', 'UBIGINT', 'BOOLEAN') ELSE kind <> 'VARCHAR' END"


def drops(spark, sf):
    pages = table(spark, sf, "pages")
    files = pages.select(F.concat(F.lit("d"), (F.col("page_id") % 20).cast("string")).alias("drop"), F.expr("CASE WHEN page_id % 20 < 15 THEN page_id || '.ndjson' ELSE page_id || '.xml' END").alias("path"))
    return quality.no_files(files.select(F.col("drop").alias("file")).distinct(), files)


def newline(spark, sf):
    pages = table(spark, sf, "pages")
    return quality.missing_newline(pages.select(F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("file"), F.expr("CASE page_id % 3 WHEN 0 THEN html || '\n' WHEN 1 THEN html ELSE '' END").alias("content")))


# ---- privacy


def people(spark, sf):
    """Known people with their labels: the two-word names of the parts."""
    names = table(spark, sf, "part").select(F.split("p_name", " ")[0].alias("first"), F.split("p_name", " ")[1].alias("last")).distinct()
    return keyed.pseudonym_labels(names.withColumn("person_key", F.concat_ws(" ", "last", "first"))).select("first", "last", "label")


NUMBERED = "(SELECT first, last, row_number() OVER (ORDER BY last, first) AS n FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS last FROM part))"
_SAW = "'Saw ' || upper(p_name) || ' and ' || split_part(p_name, ' ', 2) || ',  ' || split_part(p_name, ' ', 1) || ' today, x' || p_name"


def texts(spark, sf, sql):
    """(p_partkey, text), dealt over tasks while the rows are short."""
    return spread(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", F.expr(sql).alias("text"))


_NOTE = f"'{{\"' || p_name || '\":[{{\"note\":\"' || {_SAW} || '\"}},1,null,true]}}'"
_BROKEN = f"'{{\"cut\": ' || {_SAW}"
_CDA = "'<ClinicalDocument xmlns=\"urn:x\"><recordTarget><patientRole><patient><name use=\"L\"><given>' || split_part(p_name, ' ', 1) || '</given><family>' || split_part(p_name, ' ', 2) || '</family></name><birthTime value=\"19800102\"/></patient><providerOrganization><name>Clinic ' || p_partkey || '</name></providerOrganization></patientRole></recordTarget><author><name>' || split_part(p_name, ' ', 2) || ', ' || upper(split_part(p_name, ' ', 1)) || '</name></author></ClinicalDocument>'"


def redacted_sql(text):
    return f"SELECT p_partkey, {text} AS text FROM part JOIN {NUMBERED} ON first = split_part(p_name, ' ', 1) AND last = split_part(p_name, ' ', 2)"


_SEEN = "'Saw Patient ' || n || ' and Patient ' || n || ' today, x' || p_name"


def redact_patient(spark, sf):
    rows = clinical.valid_resources(clinical.raw_resources(spark, sf)).where("kind = 'Patient'").select("event_id", "text", F.lit("Patient 1").alias("label"))
    return privacy.redact_patients(rows, "text", "label", people(spark, sf)).select("event_id", "text")


def redact_cda(spark, sf):
    out = privacy.redact_cdas(texts(spark, sf, _CDA).withColumn("label", F.lit("Patient 1")), "text", "label", people(spark, sf))
    return cda_names(out.select("p_partkey", "text"))


def cda_names(documents):
    """(p_partkey, name, provider, birth, author) of documents (p_partkey, text), each parsed once: the text of the first name of
    a patient, a provider and an author, and the first birth time; empty where there is none."""
    names = [f".//{{urn:x}}{who}/{{urn:x}}name" for who in ("patient", "providerOrganization", "author")]

    def of(text):
        root = ET.fromstring(text)
        name, provider, author = ("" if (e := root.find(path)) is None else "".join(e.itertext()) for path in names)
        birth = next((e.get("value") for e in root.iter("{urn:x}birthTime") if e.get("value") is not None), "")
        return name, provider, birth, author

    def run(batches):
        for batch in batches:
            found = zip(*map(of, batch.column(1).to_pylist())) if batch.num_rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in found)], ["p_partkey", "name", "provider", "birth", "author"])

    return documents.mapInArrow(run, "p_partkey long, name string, provider string, birth string, author string")


def redacted_manifest(spark, sf):
    """The redacted texts as files, one for each 64 parts, and the manifest of what was written: sizes and hashes of the output."""
    root = new_folder(spark, "redacted")
    rows = privacy.redact_names(texts(spark, sf, _SAW), "text", people(spark, sf)).withColumn("k", F.expr("p_partkey div 64"))
    spread(rows, "k").sortWithinPartitions("k", "p_partkey").select("k", F.col("text").alias("value")).write.partitionBy("k").text(root)
    return files.manifest(spark, root).select(F.regexp_extract("path", "/k=(\\d+)/", 1).cast("long").alias("k"), "size", "sha256")


# ---- identity


def patient_hits(spark, sf):
    """(event_id, first, last, ids): the patients that a walk over all resources finds."""
    from ..functions.columns import name_parts

    raw = clinical.raw_resources(spark, sf)
    found = clinical.walk(raw.select("file", "text"), ("Patient",))
    parts = name_parts(clinical.patient_name())
    rows = found.select(F.regexp_extract("file", r"(\d+)", 1).cast("long").alias("event_id"), parts.alias("n"), clinical.patient_ids().alias("ids")).where("n is not null")
    return rows.select("event_id", fold_name(F.col("n.first")).alias("first"), fold_name(F.col("n.last")).alias("last"), F.to_json("ids").alias("ids"))


def assign_person(spark, sf):
    rows = hits(spark, sf).select(F.col("p_partkey").alias("hit"), F.array("external_id", F.concat(F.lit("mrn"), F.expr("cast(p_partkey div 3 as string)"))).alias("ids"), F.concat_ws(" ", "first", "last").alias("name"))
    names = rows.where("hit % 17 = 0").select("name", F.concat(F.lit("known"), F.col("hit").cast("string")).alias("person"))
    links = rows.where("hit % 50 = 0 and hit < 700").select(F.col("ids")[0].alias("id"), F.concat(F.lit("linked"), F.col("hit").cast("string")).alias("person"))
    return identity.assign_persons(rows, links, names, "run", written)


# ---- profiles of documents


def tag_counts(spark, sf):
    """Start tags by local name, the 50 most frequent."""
    tags = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r"<\s*([A-Za-z_][A-Za-z0-9_.:-]*)"), F.lit(1))).alias("t"))
    return tags.groupBy(F.regexp_replace("t", "^[^:]*:", "").alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(50)


def hk_type_counts(spark, sf):
    """Types of device records counted in raw text, without parsing it."""
    raw = table(spark, sf, "events").select(F.concat(F.lit('<Record type="HK'), "event_type", F.lit('" unit="x"/><Record type=\'HKOther\'/>')).alias("xml"))
    return raw.select(F.explode(F.regexp_extract_all("xml", F.lit("<Record[^>]*\\btype=[\"']([^\"']+)[\"']"), F.lit(1))).alias("hk_type")).groupBy("hk_type").agg(F.count("*").alias("n"))


_EXPORT = "concat('<Record type=\"HK', event_type, '\"/>', chr(10), CASE WHEN event_id % 3 = 0 THEN concat('<Workout/><Record', chr(10), ' type=\"x\"/>') ELSE '<record/>' END, chr(10))"


def record_estimate(spark, sf):
    """Estimated records (start tags of device records) and newlines of the raw exports of each user, without parsing them."""
    raw = table(spark, sf, "events").select("user_id", F.expr(_EXPORT).alias("xml"))
    return raw.groupBy("user_id").agg(F.sum(F.regexp_count("xml", F.lit("<Record"))).alias("records"), F.sum(F.regexp_count("xml", F.lit("\n"))).alias("newlines"))


def resource_type_counts(spark, sf):
    sample = clinical.raw_resources(spark, sf).orderBy("file").limit(200)
    return sample.groupBy(F.regexp_extract("text", r'"resourceType"\s*:\s*"([^"]+)"', 1).alias("resource_type")).agg(F.count("*").alias("n")).where("resource_type <> ''")


KIND = "CASE event_id % 7 WHEN 0 THEN 'Observation' WHEN 1 THEN 'Observation' WHEN 2 THEN 'DocumentReference' WHEN 3 THEN 'MedicationRequest' WHEN 4 THEN 'Condition' WHEN 5 THEN 'Patient' END"

QUERIES = {
    "validate_no_files": drops,
    "validate_newline": newline,
    "validate_empty_line": lambda s, d: quality.empty_lines(lines(s, d)),
    "validate_banned": lambda s, d: quality.banned(lines(s, d), TOKENS, PATTERNS),
    "validate_json": lambda s, d: quality.bad_json(lines(s, d)),
    "validate_required": lambda s, d: quality.required_keys(lines(s, d)),
    "validate_all": lambda s, d: quality.all_errors(lines(s, d), TOKENS, PATTERNS),
    "redact_names": lambda s, d: privacy.redact_names(texts(s, d, _SAW), "text", people(s, d)),
    "redact_json_strings": lambda s, d: privacy.redact_names(texts(s, d, _NOTE), "text", people(s, d), as_json=True),
    "redact_fallback": lambda s, d: privacy.redact_names(texts(s, d, _BROKEN), "text", people(s, d), as_json=True),
    "redact_patient": redact_patient,
    "redact_cda": redact_cda,
    "redacted_manifest": redacted_manifest,
    "patient_hits": patient_hits,
    "walk_resources": lambda s, d: clinical.walk(clinical.raw_resources(s, d).select("file", F.concat(F.lit('{"resourceType":"Bundle","entry":[{"resource":'), "text", F.lit("}]}")).alias("text"))).select("file", "path", "kind"),
    "assign_person": assign_person,
    "tag_counts": tag_counts,
    "hk_type_counts": hk_type_counts,
    "record_estimate": record_estimate,
    "resource_type_counts": resource_type_counts,
}

#: Hits one after the other, each with what the earlier ones have claimed.
ASSIGNED = f"""WITH RECURSIVE raw AS (SELECT p_partkey AS hit, external_id AS a, 'mrn' || (p_partkey // 3) AS b, first || ' ' || last AS name FROM {HITS}),
links AS (SELECT a AS id, 'linked' || hit AS person FROM raw WHERE hit % 50 = 0 AND hit < 700),
own_names AS (SELECT name, MIN('known' || hit) AS person FROM raw WHERE hit % 17 = 0 GROUP BY 1 HAVING COUNT(DISTINCT hit) = 1),
uniq AS (SELECT name FROM raw GROUP BY 1 HAVING COUNT(*) = 1),
h AS (SELECT row_number() OVER (ORDER BY hit) AS n, hit, a, b, la.person AS la, lb.person AS lb, o.person AS named,
  COALESCE(o.person, left(sha256('run:' || hit), 32)) AS own
  FROM raw LEFT JOIN links la ON la.id = a LEFT JOIN links lb ON lb.id = b LEFT JOIN uniq USING (name) LEFT JOIN own_names o ON o.name = uniq.name),
f AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS hit, NULL::VARCHAR AS person_key, NULL::VARCHAR AS state, MAP {{'' : ''}} AS claimed
  UNION ALL
  SELECT n, hit, CASE WHEN pa IS NULL AND pb IS NULL THEN own WHEN pa <> pb THEN NULL ELSE COALESCE(pa, pb) END,
    CASE WHEN pa IS NULL AND pb IS NULL THEN CASE WHEN named IS NULL THEN 'new' ELSE 'unverified' END WHEN pa <> pb THEN 'conflict' ELSE 'verified' END,
    CASE WHEN pa IS NULL AND pb IS NULL THEN map_concat(claimed, MAP {{a : own, b : own}}) ELSE claimed END
  FROM (SELECT h.*, f.claimed, COALESCE(f.claimed[h.a], h.la) AS pa, COALESCE(f.claimed[h.b], h.lb) AS pb FROM f JOIN h ON h.n = f.n + 1))
SELECT hit, person_key, state FROM f WHERE n > 0"""

ORACLE_SQL = {
    "assign_person": ASSIGNED,
    "validate_no_files": "SELECT DISTINCT 'd' || (page_id % 20) AS file, 0::BIGINT AS line_no, 'no_ndjson_files' AS code, '' AS detail FROM pages WHERE page_id % 20 >= 15",
    "validate_newline": "SELECT 'f' || page_id AS file, 0::BIGINT AS line_no, 'missing_trailing_newline' AS code, '' AS detail FROM pages WHERE page_id % 3 = 1",
    "validate_empty_line": EMPTY,
    "validate_banned": BANNED,
    "validate_json": JSON,
    "validate_required": KEYS,
    "validate_all": f"{EMPTY} UNION ALL {BANNED} UNION ALL {JSON} UNION ALL {KEYS}",
    "redact_names": redacted_sql(_SEEN),
    "redact_json_strings": redacted_sql(f"'{{\"' || p_name || '\":[{{\"note\":\"' || {_SEEN} || '\"}},1,null,true]}}'"),
    "redact_fallback": redacted_sql(f"'{{\"cut\": ' || {_SEEN}"),
    "redact_patient": "SELECT event_id, '{\"resourceType\":\"Patient\",\"id\":\"u' || user_id || '\",\"birthDate\":\"1900-01-01\",\"name\":[{\"given\":[\"Patient\"],\"family\":\"1\",\"text\":\"Patient 1\"}],\"identifier\":[{\"system\":\"mrn\",\"value\":\"m' || (user_id % 60) || '\"},{\"system\":\"\",\"value\":\"x\"}]}' AS text FROM events WHERE event_id % 7 = 5",
    "redact_cda": redacted_sql("'Patient 1' AS name, 'Clinic ' || p_partkey AS provider, '19000101' AS birth, 'Patient ' || n").replace(" AS text ", " AS author "),
    "redacted_manifest": f"SELECT p_partkey // 64 AS k, octet_length(encode(content))::BIGINT AS size, sha256(content) AS sha256 FROM (SELECT p_partkey // 64 AS p_partkey, string_agg(text || chr(10), '' ORDER BY p_partkey) AS content FROM ({redacted_sql(_SEEN)}) GROUP BY 1)".replace("SELECT p_partkey // 64 AS k, octet", "SELECT p_partkey AS k, octet"),
    "patient_hits": "SELECT event_id, 'ann' || (user_id % 40) AS first, 'lee' || (user_id % 7) AS last, '[{\"system\":\"fhir:id\",\"value\":\"u' || user_id || '\"},{\"system\":\"mrn\",\"value\":\"m' || (user_id % 60) || '\"}]' AS ids FROM events WHERE event_id % 7 = 5",
    "walk_resources": f"SELECT 'clinical-records/' || event_id || '.json' AS file, '$' AS path, 'Bundle' AS kind FROM events WHERE NOT (event_id % 7 = 6 AND event_id % 2 = 0) UNION ALL SELECT 'clinical-records/' || event_id || '.json', '$.entry[000000].resource', {KIND} FROM events WHERE event_id % 7 < 6",
    "tag_counts": "SELECT regexp_replace(t, '^[^:]*:', '') AS tag, COUNT(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<\\s*([A-Za-z_][A-Za-z0-9_.:-]*)', 1)) AS t FROM pages) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "hk_type_counts": "SELECT 'HK' || event_type AS hk_type, COUNT(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'HKOther', COUNT(*) FROM events",
    "record_estimate": f"SELECT user_id, SUM(len(regexp_extract_all(xml, '<Record')))::BIGINT AS records, SUM(len(regexp_extract_all(xml, chr(10))))::BIGINT AS newlines FROM (SELECT user_id, {_EXPORT} AS xml FROM events) GROUP BY 1",
    "resource_type_counts": f"SELECT resource_type, COUNT(*) AS n FROM (SELECT {KIND} AS resource_type FROM events ORDER BY 'clinical-records/' || event_id || '.json' LIMIT 200) WHERE resource_type IS NOT NULL GROUP BY 1",
}
