"""Queries of joins, keys, windows and lineage, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyed
from ..sources.sinks import SIX_KEYS
from ..sources.tables import EVENTS_SQL, all_events, table
from .scalar_queries import PATHS, allowlist_paths, paths


def person_map(spark, sf):
    """(system, value, person) from alias rows: the last alias of an external id counts."""
    orders = table(spark, sf, "orders").select(F.lit("cust").alias("system"), F.col("o_custkey").cast("string").alias("value"), F.concat(F.lit("p"), (F.col("o_orderkey") % 150).cast("string")).alias("person"), F.col("o_orderkey").alias("observed"))
    return orders.groupBy("system", "value").agg(F.max_by("person", "observed").alias("person"))


def resolve_person(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.lit("cust").alias("system"), F.col("o_custkey").cast("string").alias("value"))
    known = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.lit("cust").alias("system"), F.col("c_custkey").cast("string").alias("value"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("person"))
    return keyed.resolve_person(rows, known).select("o_orderkey", "canonical_person_id")


def resolve_default(spark, sf):
    """With one known person all rows without an own mapping are that person's."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.lit("cust").alias("system"), F.col("o_custkey").cast("string").alias("value"))
    known = table(spark, sf, "customer").agg(F.min("c_custkey").alias("k")).select(F.lit("cust").alias("system"), F.col("k").cast("string").alias("value"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("person"))
    return keyed.resolve_person(rows, known, keyed.default_person(known)).select("o_orderkey", "canonical_person_id")


def documents_keyed(spark, sf):
    return table(spark, sf, "documents").select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("record_key"), "doc_id", "source")


def append_if_absent(spark, sf):
    docs = documents_keyed(spark, sf)
    old = keyed.keep_first(docs.where("doc_id % 3 <> 0"), "record_key", "doc_id")
    return keyed.append_if_absent(old, docs.where("doc_id % 3 < 2"), "record_key", "doc_id")


def load_replace(spark, sf):
    """Replace instead of append: the second load stands alone."""
    return keyed.keep_first(documents_keyed(spark, sf).where("doc_id % 3 < 2"), "record_key", "doc_id")


def hits(spark, sf):
    """Patient hits from the parts: names with few values, two runs, two external ids each."""
    return table(spark, sf, "part").select("p_partkey", F.expr("'run' || (p_partkey div 3) % 2").alias("run_id"), F.split("p_name", " ")[0].alias("first"), F.concat(F.split("p_name", " ")[1], (F.col("p_partkey") % 50).cast("string")).alias("last"), F.concat(F.lit("id"), (F.col("p_partkey") % 700).cast("string")).alias("external_id"))


HITS = "(SELECT p_partkey, 'run' || ((p_partkey // 3) % 2) AS run_id, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) || (p_partkey % 50) AS last, 'id' || (p_partkey % 700) AS external_id FROM part)"


def match_by_name(spark, sf):
    """Hits of run1 whose name occurs once in the run and belongs to one person (a distinct id of run0)."""
    rows = hits(spark, sf)
    unique = rows.where("run_id = 'run1'").groupBy("first", "last").agg(F.count("*").alias("n"), F.min("p_partkey").alias("p_partkey")).where("n = 1")
    people = rows.where("run_id = 'run0'").select("first", "last", "external_id").groupBy("first", "last").agg(F.count_distinct("external_id").alias("people"), F.min("external_id").alias("person")).where("people = 1")
    return unique.join(people, ["first", "last"]).select("p_partkey", "person")


def match_by_external_id(spark, sf):
    """Hits of run1 joined to the persons of run0 by fingerprint; conflict where one id points to several persons."""
    rows = hits(spark, sf).withColumn("fp", F.sha2(F.col("external_id").cast("binary"), 256))
    people = rows.where("run_id = 'run0'").select("fp", F.concat_ws(" ", "first", "last").alias("person"))
    known = people.groupBy("fp").agg(F.count_distinct("person").alias("persons"), F.min("person").alias("person"))
    return rows.where("run_id = 'run1'").join(known, "fp").select("p_partkey", "person", (F.col("persons") > 1).alias("conflict"))


def manifests(spark, sf):
    files = table(spark, sf, "pages").select(F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("path"), "page_id", F.length("html").cast("long").alias("size"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))
    listed = files.where("page_id % 7 <> 0").withColumn("size", F.when(F.col("page_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("sha256", F.when(F.col("page_id") % 4 == 0, "0").otherwise(F.col("sha256")))
    return listed, files.where("page_id % 11 <> 0")


def fingerprints(fields):
    def query(spark, sf):
        docs = table(spark, sf, "documents")
        files = docs.select(F.col("source").alias("drop_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
        line = F.concat(F.concat_ws("|", *[F.col(f).cast("string") for f in fields]), F.lit("\n"))
        return keyed.fingerprint(files, "drop_id", line)

    return query


FILES = "(SELECT source AS drop_id, lpad(doc_id::VARCHAR, 12, '0') AS path, octet_length(encode(COALESCE(text, '')))::BIGINT AS size, sha256(COALESCE(text, '')) AS sha FROM documents)"


def fingerprint_sql(fields):
    line = " || '|' || ".join(fields)
    inner = f"SELECT drop_id, left(sha256(path), 3) AS part, sha256(string_agg({line} || chr(10), '' ORDER BY path)) AS part_sha, COUNT(*) AS n, SUM(size) AS total FROM {FILES} GROUP BY 1, 2"
    return f"SELECT drop_id, sha256(string_agg(part_sha, '' ORDER BY part)) AS sha256, SUM(n)::BIGINT AS file_count, SUM(total)::BIGINT AS total_bytes FROM ({inner}) GROUP BY 1"


FULL = ["path", "size", "sha"]


def run_rows(spark, sf):
    """Runs in a chain by source; every third repeats its parent's fingerprint."""
    base = fingerprints(FULL)(spark, sf).withColumn("no", F.regexp_extract("drop_id", r"(\d+)", 1).cast("int"))
    return base.select(F.concat(F.lit("r"), F.col("no").cast("string")).alias("run_id"), F.when(F.col("no") > 0, F.concat(F.lit("r"), (F.col("no") - 1).cast("string"))).alias("parent_run_id"), F.when(F.col("no") % 3 == 0, "same").when(F.col("no") % 3 == 1, "same").otherwise(F.col("sha256")).alias("sha256"), "file_count", "total_bytes")


RUNS = f"(SELECT 'r' || no AS run_id, CASE WHEN no > 0 THEN 'r' || (no - 1) END AS parent_run_id, CASE WHEN no % 3 < 2 THEN 'same' ELSE sha256 END AS sha256, file_count, total_bytes FROM (SELECT *, regexp_extract(drop_id, '(\\d+)', 1)::INT AS no FROM ({fingerprint_sql(FULL)})))"


def run_id_query(spark, sf):
    return run_rows(spark, sf).select("run_id", keyed.run_id(F.col("parent_run_id"), F.col("sha256")).alias("derived_run_id"))


def register_run(spark, sf):
    rows = run_rows(spark, sf)
    return keyed.register_runs(rows.where("file_count % 2 = 0"), rows.unionByName(rows))


def run_inputs(spark, sf):
    """Inputs to be run: each source again, every fifth with the fingerprint that its last run had; some name a run to follow or
    the run id that they expect."""
    rows = run_rows(spark, sf).withColumn("no", F.substring("run_id", 2, 9).cast("int"))
    again = F.when(F.col("no") % 5 < 2, F.col("sha256")).otherwise(F.sha2(F.concat("sha256", F.lit("+")).cast("binary"), 256))
    return rows.select(F.concat(F.lit("in"), F.col("no").cast("string")).alias("input_id"), again.alias("sha256"), F.when(F.col("no") % 2 == 0, F.col("run_id")).alias("since"), F.when(F.col("no") % 3 == 0, F.lit("r0")).alias("expected_run_id"))


INPUTS = "(SELECT 'in' || substr(run_id, 2) AS input_id, CASE WHEN substr(run_id, 2)::INT % 5 < 2 THEN sha256 ELSE sha256(sha256 || '+') END AS sha256, CASE WHEN substr(run_id, 2)::INT % 2 = 0 THEN run_id END AS since, CASE WHEN substr(run_id, 2)::INT % 3 = 0 THEN 'r0' END AS expected_run_id FROM " + RUNS + ")"


def plan_runs(spark, sf):
    """What each input's run is: its parent (the one it names, else the last), its id, and whether it is one at all."""
    runs = run_rows(spark, sf).withColumn("created", F.substring("run_id", 2, 9).cast("int"))
    return keyed.plan_runs(runs, run_inputs(spark, sf), "created")


def artifacts(spark, sf):
    """(run_id, name, path) of the files that registered runs point to."""
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("dir")) for n, d in (("report", "reports"), ("note", "note"), ("staging", "staging"), ("deid", "deid"))])).alias("a")
    return run_rows(spark, sf).select("run_id", names).select("run_id", "a.name", F.concat_ws("/", "run_id", "a.dir", F.concat("a.name", F.lit(".json"))).alias("path"))


def bundle_entries(spark, sf):
    return keyed.bundle_entries(run_rows(spark, sf), artifacts(spark, sf), ("reports", "note", "deid"))


def run_report(spark, sf):
    """One row per run: rows, stages that ran, staged files, and the manifest hash over all records in key order."""
    ev = all_events(spark, sf)
    counts = ev.groupBy("run_id").agg(F.count("*").alias("rows"), *[(F.count_if(F.col("stream") == s) > 0).alias(f"has_{s}") for s in ("observations", "documents", "medications", "conditions")], F.count_distinct("source_file").alias("staged_files"), (F.count("canonical_person_id") > 0).alias("identity_executed"), (F.count_if(F.col("source_file").like("ndjson/%")) == 0).alias("deid_executed"))
    records = ev.select("run_id", F.col("record_key").alias("path"), F.lit(1).alias("size"))
    manifest = keyed.fingerprint(records, "run_id", F.concat("path", F.lit("\n"))).select("run_id", F.col("sha256").alias("manifest_sha256"))
    return counts.join(manifest, "run_id")


def pseudonym_labels(spark, sf):
    people = hits(spark, sf).select(F.col("p_partkey").alias("person_key"), "first", "last")
    return keyed.pseudonym_labels(people)


SOURCE_ID = "CASE WHEN resource_type IS NOT NULL THEN concat(resource_type, '/', record_key) END"


def canonical_sort(spark, sf):
    """The rows of all streams with their place in the six-key order, NULL as empty."""
    ev = all_events(spark, sf).withColumn("source_id", F.expr(SOURCE_ID)).withColumn("event_key", F.col("record_key"))
    keys = ev.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in SIX_KEYS])
    return keyed.numbered(keys, "place", *SIX_KEYS).select(F.col("event_key").alias("record_key"), "place")


def bundle_manifest(spark, sf):
    return paths(spark, sf).join(allowlist_paths(spark, sf).select("page_id"), "page_id", "left_semi").select("path", "size", "sha256")


def person_links(spark, sf):
    """Link rows (system and id fingerprints, person, state), the first of each id by hit order."""
    rows = hits(spark, sf).select("p_partkey", "external_id", F.concat_ws(" ", "first", "last").alias("person"))
    links = keyed.keep_first(rows, "external_id", "p_partkey")
    return links.select(F.sha2(F.lit("mrn").cast("binary"), 256).alias("system_fingerprint"), F.sha2(F.concat(F.lit("mrn:"), F.col("external_id")).cast("binary"), 256).alias("source_patient_id"), F.col("person").alias("person_key"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' WHEN 2 THEN 'user_confirmed' ELSE 'odd' END").alias("verification_state"))


LINKS = f"(SELECT sha256('mrn') AS system_fingerprint, sha256('mrn:' || external_id) AS source_patient_id, arg_min(first || ' ' || last, p_partkey) AS person_key, CASE MIN(p_partkey) % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' WHEN 2 THEN 'user_confirmed' ELSE 'odd' END AS verification_state FROM {HITS} GROUP BY external_id)"
STATES = ("verified", "unverified", "user_confirmed")


def with_link_id(links):
    return links.withColumn("link_id", F.sha2(F.concat_ws("|", "system_fingerprint", "source_patient_id", "person_key").cast("binary"), 256))


LINK_ID = "sha256(system_fingerprint || '|' || source_patient_id || '|' || person_key)"


def review_links(spark, sf):
    return with_link_id(person_links(spark, sf).where("verification_state = 'unverified'")).orderBy("link_id")


def confirm_links(spark, sf):
    """Links after a table of confirmations; a confirmation of no link comes back as unknown."""
    links = with_link_id(person_links(spark, sf))
    asked = links.where("verification_state = 'unverified' and link_id < '8'").select("link_id").unionByName(links.where("link_id >= 'f'").select(F.concat(F.lit("x"), "link_id").alias("link_id")))
    marked = links.join(asked.withColumn("asked", F.lit(True)), "link_id", "left").select("link_id", F.when(F.col("asked"), "user_confirmed").otherwise(F.col("verification_state")).alias("verification_state"))
    return marked.unionByName(asked.join(links, "link_id", "left_anti").select("link_id", F.lit("unknown_link").alias("verification_state")))


def person_aliases(spark, sf):
    """Alias rows keyed by their payload, appended only where the key is new."""
    rows = hits(spark, sf).select(F.sha2(F.concat_ws("|", "first", "last", "external_id").cast("binary"), 256).alias("alias_key"), "first", "last", "external_id", "p_partkey")
    return keyed.append_if_absent(keyed.keep_first(rows.where("p_partkey % 2 = 0"), "alias_key", "p_partkey"), rows, "alias_key", "p_partkey")


def identity_conflicts(spark, sf):
    rows = hits(spark, sf)
    return rows.groupBy("external_id").agg(F.count_distinct(F.concat_ws(" ", "first", "last")).alias("persons")).where("persons > 1")


KEYED_DOCS = "(SELECT sha256(COALESCE(text, '')) AS record_key, doc_id, source FROM documents)"
FIRST_DOC = "SELECT record_key, MIN(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM {d} WHERE {w} GROUP BY 1"

QUERIES = {
    "person_map": person_map,
    "resolve_person": resolve_person,
    "append_if_absent": append_if_absent,
    "load_replace": load_replace,
    "dedupe_keep_first": lambda s, d: keyed.keep_first(documents_keyed(s, d), "record_key", "doc_id"),
    "match_by_name": match_by_name,
    "match_by_external_id": match_by_external_id,
    "manifest_verify": lambda s, d: keyed.reconcile(*manifests(s, d)),
    "path_difference": lambda s, d: keyed.path_difference(*manifests(s, d)),
    "input_fingerprint": fingerprints(FULL),
    "drop_run_id": fingerprints(["path", "sha"]),
    "profile_id": fingerprints(["path", "size"]),
    "manifest_fingerprint": lambda s, d: run_rows(s, d).select("run_id", "sha256", "file_count", "total_bytes"),
    "run_id": run_id_query,
    "register_run": register_run,
    "detect_no_change": lambda s, d: keyed.detect_no_change(run_rows(s, d)),
    "run_report": run_report,
    "plan_runs": plan_runs,
    "bundle_entries": bundle_entries,
    "resolve_default": resolve_default,
    "apply_deletes": lambda s, d: keyed.apply_deletes(documents_keyed(s, d), documents_keyed(s, d).where("doc_id % 5 = 0"), "record_key"),
    "pseudonym_labels": pseudonym_labels,
    "canonical_sort": canonical_sort,
    "bundle_manifest": bundle_manifest,
    "name_collisions": lambda s, d: keyed.collisions(hits(s, d)),
    "person_links": person_links,
    "valid_links": lambda s, d: person_links(s, d).where(F.col("verification_state").isin(*STATES)),
    "review_links": review_links,
    "confirm_links": confirm_links,
    "person_aliases": person_aliases,
    "identity_conflicts": identity_conflicts,
}

LISTED = "(SELECT 'f' || page_id AS path, length(html) + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN page_id % 4 = 0 THEN '0' ELSE sha256(html) END AS sha256 FROM pages WHERE page_id % 7 <> 0)"
ACTUAL = "(SELECT 'f' || page_id AS path, length(html) AS size, sha256(html) AS sha256 FROM pages WHERE page_id % 11 <> 0)"

ORACLE_SQL = {
    "person_map": "SELECT 'cust' AS system, o_custkey::VARCHAR AS value, 'p' || (MAX(o_orderkey) % 150) AS person FROM orders GROUP BY o_custkey",
    "resolve_person": "SELECT o_orderkey, COALESCE('p' || c_custkey, 'unresolved') AS canonical_person_id FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey",
    "append_if_absent": f"WITH old AS ({FIRST_DOC.format(d=KEYED_DOCS, w='doc_id % 3 <> 0')}), new AS ({FIRST_DOC.format(d=KEYED_DOCS, w='doc_id % 3 < 2')}) SELECT * FROM old UNION ALL SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.record_key = new.record_key)",
    "load_replace": FIRST_DOC.format(d=KEYED_DOCS, w="doc_id % 3 < 2"),
    "dedupe_keep_first": FIRST_DOC.format(d=KEYED_DOCS, w="true"),
    "match_by_name": f"WITH u AS (SELECT first, last, MIN(p_partkey) AS p_partkey FROM {HITS} WHERE run_id = 'run1' GROUP BY 1, 2 HAVING COUNT(*) = 1), p AS (SELECT first, last, MIN(external_id) AS person FROM {HITS} WHERE run_id = 'run0' GROUP BY 1, 2 HAVING COUNT(DISTINCT external_id) = 1) SELECT p_partkey, person FROM u JOIN p USING (first, last)",
    "match_by_external_id": f"WITH k AS (SELECT external_id, COUNT(DISTINCT first || ' ' || last) AS persons, MIN(first || ' ' || last) AS person FROM {HITS} WHERE run_id = 'run0' GROUP BY 1) SELECT p_partkey, person, persons > 1 AS conflict FROM {HITS} h JOIN k USING (external_id) WHERE run_id = 'run1'",
    "manifest_verify": f"SELECT COALESCE(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' WHEN a.size <> b.size THEN 'size_mismatch' WHEN a.sha256 <> b.sha256 THEN 'hash_mismatch' ELSE 'ok' END AS state FROM {LISTED} a FULL JOIN {ACTUAL} b ON a.path = b.path",
    "path_difference": f"SELECT 'left' AS side, path FROM (SELECT path FROM {LISTED} EXCEPT SELECT path FROM {ACTUAL}) UNION ALL SELECT 'right', path FROM (SELECT path FROM {ACTUAL} EXCEPT SELECT path FROM {LISTED})",
    "input_fingerprint": fingerprint_sql(FULL),
    "drop_run_id": fingerprint_sql(["path", "sha"]),
    "profile_id": fingerprint_sql(["path", "size"]),
    "manifest_fingerprint": f"SELECT run_id, sha256, file_count, total_bytes FROM {RUNS}",
    "run_id": f"SELECT run_id, sha256('vitalstream-run|' || COALESCE(parent_run_id, '') || '|' || sha256) AS derived_run_id FROM {RUNS}",
    "register_run": f"SELECT * FROM {RUNS}",
    "detect_no_change": f"SELECT a.run_id, COALESCE(a.sha256 = b.sha256, false) AS no_change FROM {RUNS} a LEFT JOIN {RUNS} b ON a.parent_run_id = b.run_id",
    "run_report": EVENTS_SQL + "SELECT run_id, rows, has_observations, has_documents, has_medications, has_conditions, staged_files, identity_executed, deid_executed, manifest_sha256 FROM (SELECT run_id, COUNT(*) AS rows, bool_or(stream = 'observations') AS has_observations, bool_or(stream = 'documents') AS has_documents, bool_or(stream = 'medications') AS has_medications, bool_or(stream = 'conditions') AS has_conditions, COUNT(DISTINCT source_file) AS staged_files, COUNT(canonical_person_id) > 0 AS identity_executed, COUNT(*) FILTER (source_file LIKE 'ndjson/%') = 0 AS deid_executed FROM ev GROUP BY 1) JOIN (SELECT run_id, sha256(string_agg(h, '' ORDER BY part)) AS manifest_sha256 FROM (SELECT run_id, left(sha256(record_key), 3) AS part, sha256(string_agg(record_key || chr(10), '' ORDER BY record_key)) AS h FROM ev GROUP BY 1, 2) GROUP BY 1) USING (run_id)",
    "plan_runs": f"WITH r AS {RUNS}, i AS {INPUTS}, last AS (SELECT arg_max(run_id, substr(run_id, 2)::INT) AS run_id FROM r), p AS (SELECT i.*, COALESCE(since, (SELECT run_id FROM last)) AS parent_run_id FROM i), f AS (SELECT p.*, r.sha256 IS NOT DISTINCT FROM p.sha256 AS same FROM p LEFT JOIN r ON r.run_id = p.parent_run_id) SELECT input_id, parent_run_id, CASE WHEN same THEN parent_run_id ELSE sha256('vitalstream-run|' || parent_run_id || '|' || sha256) END AS run_id, CASE WHEN expected_run_id <> CASE WHEN same THEN parent_run_id ELSE sha256('vitalstream-run|' || parent_run_id || '|' || sha256) END THEN 'unexpected_run_id' WHEN same THEN 'no_change' ELSE 'run' END AS state FROM f",
    "bundle_entries": f"SELECT run_id, parent_run_id, sha256, file_count, total_bytes, a.name, run_id || '/' || a.dir || '/' || a.name || '.json' AS path FROM {RUNS}, (SELECT unnest([{{'name': 'report', 'dir': 'reports'}}, {{'name': 'note', 'dir': 'note'}}, {{'name': 'deid', 'dir': 'deid'}}]) AS a)",
    "resolve_default": "SELECT o_orderkey, 'p' || (SELECT MIN(c_custkey) FROM customer) AS canonical_person_id FROM orders",
    "apply_deletes": f"SELECT * FROM {KEYED_DOCS} WHERE record_key NOT IN (SELECT record_key FROM {KEYED_DOCS} WHERE doc_id % 5 = 0)",
    "pseudonym_labels": f"SELECT p_partkey AS person_key, first, last, 'Patient ' || row_number() OVER (ORDER BY last, first, p_partkey) AS label FROM {HITS}",
    "canonical_sort": EVENTS_SQL + f"SELECT record_key, row_number() OVER (ORDER BY COALESCE(event_time::VARCHAR, ''), COALESCE(canonical_person_id, ''), COALESCE(source, ''), COALESCE(source_file, ''), COALESCE({SOURCE_ID}, ''), record_key) AS place FROM ev",
    "bundle_manifest": f"SELECT path, size, sha256 FROM {PATHS} WHERE page_id % 6 = 3",
    "name_collisions": f"SELECT run_id, first, last, COUNT(*) AS hits FROM {HITS} GROUP BY 1, 2, 3 HAVING COUNT(*) > 1",
    "person_links": f"SELECT * FROM {LINKS}",
    "valid_links": f"SELECT * FROM {LINKS} WHERE verification_state IN {STATES}",
    "review_links": f"SELECT *, {LINK_ID} AS link_id FROM {LINKS} WHERE verification_state = 'unverified'",
    "confirm_links": f"WITH l AS (SELECT *, {LINK_ID} AS link_id FROM {LINKS}) SELECT link_id, CASE WHEN verification_state = 'unverified' AND link_id < '8' THEN 'user_confirmed' ELSE verification_state END AS verification_state FROM l UNION ALL SELECT 'x' || link_id, 'unknown_link' FROM l WHERE link_id >= 'f'",
    "person_aliases": f"WITH r AS (SELECT *, sha256(first || '|' || last || '|' || external_id) AS alias_key FROM {HITS}) SELECT alias_key, arg_min(first, (p_partkey % 2, p_partkey)) AS first, arg_min(last, (p_partkey % 2, p_partkey)) AS last, arg_min(external_id, (p_partkey % 2, p_partkey)) AS external_id, arg_min(p_partkey, (p_partkey % 2, p_partkey)) AS p_partkey FROM r GROUP BY 1",
    "identity_conflicts": f"SELECT external_id, COUNT(DISTINCT first || ' ' || last) AS persons FROM {HITS} GROUP BY 1 HAVING COUNT(DISTINCT first || ' ' || last) > 1",
}
