"""The whole job: streams to a table, a replayed drop that must change nothing, persons, redaction, reports and note."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import fold_name, name_parts
from ..operators import identity, job, keyed, privacy, reports
from ..sources import clinical, sinks
from ..sources.tables import COLUMNS, EVENTS_SQL, all_events, new_folder, written
from . import keyed_queries, quality_queries
from .report_queries import NOTE, SUMMARY


def entry(spark, sf):
    """(section, key, value): what a run does and finds.

    All streams are loaded, and loaded again append-safely; known persons and their links are counted, texts are redacted
    and shared with a manifest, and reports and note are made of the loaded table. A failed run leaves no reports behind.
    """
    first, second, shared = new_folder(spark, "load"), new_folder(spark, "reload"), new_folder(spark, "reports")
    order = [c for c in COLUMNS if c not in ("stream", "record_key")]
    drop = all_events(spark, sf)
    keyed.keep_first(drop, "record_key", *order).write.parquet(first)
    loaded = spark.read.schema(drop.schema).parquet(first)
    new = keyed.keep_first(drop.join(loaded.select("record_key"), "record_key", "left_anti").select(*COLUMNS), "record_key", *order)
    new.select(*COLUMNS).write.parquet(second)
    events = spark.read.schema(drop.schema).parquet(first, second)

    row = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    links = keyed_queries.person_links(spark, sf)
    identity = row(links.groupBy("verification_state").agg(F.count("*").alias("n")), "identity", F.col("verification_state"), F.col("n"))
    redacted = quality_queries.redacted_manifest(spark, sf)
    privacy = row(redacted.agg(F.count("*").alias("n")), "privacy", F.lit("redacted_files"), F.col("n"))
    run = keyed.fingerprint(events.select(F.lit("all").alias("run"), F.col("record_key").alias("path"), F.lit(1).alias("size")), "run", F.concat("path", F.lit("\n")))
    run = row(run, "run", F.lit("run_id"), keyed.run_id(F.lit(None).cast("string"), F.col("sha256")))
    note = written(row(reports.clinical_note(events), "note", F.col("ord"), F.col("line")))
    summary = written(reports.report_summary(events))
    sinks.report_files({"summary": (summary, ("section", "key")), "note": (note, ("key",))}, shared)
    return summary.unionByName(note).unionByName(identity).unionByName(privacy).unionByName(run)


def job_stages(spark, sf):
    """The stages of the whole job over clinical resources, each from what the ones before have written.

    staged: the resources as they came. identity: their patients' hits with the person of each. people: the persons' names and
    labels. redacted: the resources without those names. streams: canonical rows of the redacted resources under the persons
    that identity has found. tables: the first row of each key. coverage: rows and times by person and stream.
    """

    def found(done):
        patients = clinical.walk(done["staged"], ("Patient",)).withColumn("n", name_parts(clinical.patient_name())).where("n is not null")
        return patients.select(F.regexp_extract("file", r"(\d+)", 1).cast("long").alias("hit"), F.transform(clinical.patient_ids(), lambda x: F.concat_ws("|", x["system"], x["value"])).alias("ids"), fold_name(F.col("n.first")).alias("first"), fold_name(F.col("n.last")).alias("last"))

    def persons(done):
        hits, none = written(found(done)), spark.createDataFrame([], "id string, name string, person string")
        given = identity.assign_persons(hits.select("hit", "ids", F.concat_ws(" ", "first", "last").alias("name")), none.select("id", "person"), none.select("name", "person"), "run", written)
        return hits.join(given, "hit").select("hit", "ids", "first", "last", "person_key", "state")

    def people(done):
        first = keyed.keep_first(done["identity"].where("state = 'new'").select("person_key", "hit", "first", "last"), "person_key", "hit")
        return keyed.pseudonym_labels(first.drop("hit"))

    def redacted(done):
        labelled = done["staged"].withColumn("label", F.lit("Patient 1"))
        return privacy.redact_patients(labelled, "text", "label", done["people"].select("first", "last", "label")).select("file", "text")

    def streams(done):
        claims = done["identity"].where("state = 'new'").select("hit", "person_key", F.explode("ids").alias("id"))
        known = keyed.keep_first(claims, "id", "hit").select(F.lit("fhir:id").alias("system"), F.regexp_extract("id", r"^fhir:id\|(.*)$", 1).alias("value"), F.col("person_key").alias("person")).where("value <> ''")
        rows = clinical.resource_rows(done["redacted"]).withColumn("system", F.lit("fhir:id")).withColumnRenamed("value", "reading").withColumn("value", F.col("subject"))
        return keyed.resolve_person(rows, known).select("stream", "source_id", "canonical_person_id", "event_time", "code_coding_json", "type_coding_json", F.col("reading").alias("value"), "unit", "status")

    def tables(done):
        rows = done["streams"].withColumn("record_key", F.sha2(F.to_json(F.struct("stream", "source_id", "event_time", "value")).cast("binary"), 256))
        return keyed.keep_first(rows, "record_key", "source_id")

    def coverage(done):
        return done["tables"].groupBy("canonical_person_id", "stream").agg(F.count("*").alias("rows"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"))

    return [("staged", lambda done: clinical.raw_resources(spark, sf).select("file", "text")), ("identity", persons), ("people", people), ("redacted", redacted), ("streams", streams), ("tables", tables), ("coverage", coverage)]


def finished_job(spark, sf, root):
    """Run the stages to the end; the run's id and fingerprint are those of its input."""
    files = clinical.raw_resources(spark, sf).select(F.lit("all").alias("run"), F.col("file").alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    given = keyed.fingerprint(files, "run", F.concat("path", F.lit("\n"), "sha", F.lit("\n"))).select("sha256", keyed.run_id(F.lit(None).cast("string"), F.col("sha256")).alias("run_id")).first()
    if given is None:
        given = spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256).alias("sha256"), F.lit("empty").alias("run_id")).first()
    return job.run(spark, root, given.run_id, given.sha256, job_stages(spark, sf))


def whole_job(spark, sf):
    """Rows and times by person and stream, after all stages."""
    return finished_job(spark, sf, new_folder(spark, "job"))["coverage"]


def job_report(spark, sf):
    """What the job's stages recorded: a first call runs them, a second one keeps them all."""
    root = new_folder(spark, "job")
    finished_job(spark, sf, root)
    finished_job(spark, sf, root)
    return job.report(spark, root).select("registered", "stages", *[f"{s}_{what}" for s, _ in job_stages(spark, sf) for what in ("rows", "executed") if s != "people"])


QUERIES = {"entry": entry, "whole_job": whole_job, "job_report": job_report}
#: Patients of one `mrn` are one person, made by the first of them, whose own id alone is known afterwards.
JOB = """WITH first AS (SELECT MIN(event_id) AS hit, arg_min(user_id, event_id) AS user_id FROM events WHERE event_id % 7 = 5 GROUP BY user_id % 60),
rows AS (SELECT CASE event_id % 7 WHEN 2 THEN 'documents' WHEN 3 THEN 'medications' WHEN 4 THEN 'conditions' ELSE 'observations' END AS stream,
 COALESCE(substr(sha256('run:' || hit), 1, 32), 'unresolved') AS canonical_person_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS event_time
 FROM events e LEFT JOIN first f ON f.user_id = e.user_id WHERE event_id % 7 < 5),
covered AS (SELECT canonical_person_id, stream, COUNT(*) AS rows, MIN(event_time) AS first_time, MAX(event_time) AS last_time FROM rows GROUP BY 1, 2)
"""
_MANIFEST = "SELECT sha256(string_agg(h, '' ORDER BY part)) AS sha FROM (SELECT left(sha256(record_key), 3) AS part, sha256(string_agg(record_key || chr(10), '' ORDER BY record_key)) AS h FROM ev GROUP BY 1)"
ORACLE_SQL = {
    "entry": EVENTS_SQL
    + f"SELECT * FROM ({SUMMARY}) UNION ALL SELECT 'note', ord::VARCHAR, line FROM ({NOTE}) UNION ALL SELECT 'identity', verification_state, COUNT(*)::VARCHAR FROM {keyed_queries.LINKS} GROUP BY 2 "
    + f"UNION ALL SELECT 'privacy', 'redacted_files', COUNT(DISTINCT p_partkey // 64)::VARCHAR FROM part UNION ALL SELECT 'run', 'run_id', sha256('vitalstream-run||' || sha) FROM ({_MANIFEST})",
    "whole_job": JOB + "SELECT * FROM covered",
    "job_report": JOB
    + "SELECT TRUE AS registered, 7::BIGINT AS stages, (SELECT COUNT(*) FROM events) AS staged_rows, TRUE AS staged_executed, (SELECT COUNT(*) FROM events WHERE event_id % 7 = 5) AS identity_rows, TRUE AS identity_executed, (SELECT COUNT(*) FROM events) AS redacted_rows, TRUE AS redacted_executed, "
    "(SELECT COUNT(*) FROM rows) AS streams_rows, TRUE AS streams_executed, (SELECT COUNT(*) FROM rows) AS tables_rows, TRUE AS tables_executed, (SELECT COUNT(*) FROM covered) AS coverage_rows, TRUE AS coverage_executed",
}
