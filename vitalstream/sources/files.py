"""Readers of raw exports. Each works on all drops at once; schemas are given, never inferred."""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import content_key, fallback_keys, normalize_time, number, parse_time

RECORD = "_type string, _unit string, _value string, _startDate string, _endDate string"


def healthkit_records(spark: SparkSession, path: str) -> DataFrame:
    """Records with a type: hk_type, value, unit, event_time (start, else end), record_key. Spark's XML reader splits the files."""
    raw = spark.read.format("xml").option("rowTag", "Record").schema(RECORD).load(path)
    time = F.coalesce(normalize_time(F.nullif(F.col("_startDate"), F.lit(""))), normalize_time(F.nullif(F.col("_endDate"), F.lit(""))))
    rows = raw.where("_type is not null and _type <> ''").select(time.alias("event_time"), F.col("_type").alias("hk_type"), F.col("_unit").alias("unit"), F.col("_value").alias("value"))
    return rows.withColumn("record_key", content_key("event_time", "hk_type", "unit", "value"))


def cda_documents(spark: SparkSession, root: str) -> DataFrame:
    """(file, content): the clinical documents below root, one a row. One document is one XML tree, so a file is not split; a
    file over 2 GB, the bound of a cell, fails."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.col("path").alias("file"), "content")


def cda_observations(documents: DataFrame) -> DataFrame:
    """documents (file, content) to one row per observation element at any depth, from its own children only.

    The XML reader's row tag would return the outer one of nested observations alone; so each document is parsed in its task,
    element by element: an observation's parts are dropped once it has been read. Text that is no XML gives no row.
    """

    def of(content: bytes) -> list[tuple]:
        local = lambda e: e.tag.rpartition("}")[2]
        rows = []
        try:
            for _, e in ET.iterparse(BytesIO(content)):
                if local(e) == "observation":
                    child = {}
                    for x in e:
                        child.setdefault(local(x), x.attrib)
                    get = lambda name, key: child.get(name, {}).get(key)
                    rows.append((get("effectiveTime", "value"), get("code", "code"), get("value", "value"), get("value", "unit")))
                    e.clear()
        except ET.ParseError:
            return []
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *r) for f, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if c for r in of(c)]
            columns = [pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 5)]
            yield pa.RecordBatch.from_arrays(columns, ["file", "time", "code", "value", "unit"])

    raw = documents.select("file", "content").mapInArrow(run, "file string, time string, code string, value string, unit string")
    return raw.select("file", normalize_time(F.col("time")).alias("event_time"), "code", "value", "unit")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, v): the lines that are not blank, parsed. A malformed line fails the job, as nothing of a bad drop may load."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"), F.parse_json("value").alias("v"))


def pick(path: str, kind: str) -> Column:
    """The value at path if it is of that JSON type, else NULL."""
    shape = {"string": "STRING", "bigint": "BIGINT"}[kind]
    at = F.try_variant_get("v", path, "variant")
    return F.when(F.schema_of_variant(at) == shape, F.try_variant_get("v", path, kind))


def observation_rows(lines: DataFrame, run_id: Column | None = None) -> DataFrame:
    """Table columns of parsed observation lines, batch or device: other keys never get into the table.

    run_id replaces the lines' own, as a device drop's manifest does.
    """
    rows = lines.where(F.schema_of_variant("v").like("OBJECT%"))
    text = lambda p: F.get_json_object("line", p)
    record, event = fallback_keys(pick("$.record_key", "string"), pick("$.event_key", "string"), F.col("line"))
    value = F.coalesce(text("$.value"), text("$.value_num"))
    return rows.select(
        pick("$.schema_version", "bigint").cast("int").alias("schema_version"),
        record.alias("record_key"),
        event.alias("event_key"),
        pick("$.canonical_person_id", "string").alias("canonical_person_id"),
        pick("$.source", "string").alias("source"),
        F.coalesce(pick("$.source_file", "string"), F.lit("ndjson/observations.ndjson")).alias("source_file"),
        parse_time(F.coalesce(pick("$.event_time", "string"), pick("$.start_time", "string"))).alias("event_time"),
        (pick("$.run_id", "string") if run_id is None else run_id).alias("run_id"),
        F.coalesce(pick("$.hk_type", "string"), pick("$.sample_type", "string")).alias("hk_type"),
        value.alias("value"),
        number(value).alias("value_num"),
        pick("$.unit", "string").alias("unit"),
    )


def device_drops(spark: SparkSession, root: str) -> DataFrame:
    """Observation rows of all device drops below root, each with its drop's run id.

    root/drops/drop=.../ holds the lines, root/manifests a manifest (drop, run_id) for each drop.
    """
    lines = spark.read.text(f"{root}/drops").where(F.trim("value") != "")
    manifests = spark.read.schema("drop string, run_id string").json(f"{root}/manifests")
    parsed = lines.select(F.col("drop").cast("string").alias("drop"), F.col("value").alias("line"), F.parse_json("value").alias("v")).join(manifests, "drop", "left")
    return observation_rows(parsed, F.col("run_id"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


#: Files up to so many bytes are hashed as one cell; larger ones in chunks of CHUNK bytes.
ONE_CELL = 256 << 20
CHUNK = 1 << 20


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha256) of all files below root, hashed where they are read; a large file is read as a stream."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = found.where(F.col("length") <= ONE_CELL).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column(0).to_pylist():
                # Spark writes a local path as file:/..., which is no URI for Arrow.
                system, inside = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
                digest = hashlib.sha256()
                with system.open_input_stream(inside) as stream:
                    while chunk := stream.read(CHUNK):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], ["path", "size", "sha256"])

    large = found.where(F.col("length") > ONE_CELL).select("path", F.col("length").alias("size"))
    return small.unionByName(large.mapInArrow(hashed, "path string, size long, sha256 string"))


#: The folders that may hold clinical records, the first existing one counts.
CLINICAL_DIRS = ("clinical-records", "clinical_records", "clinical/clinical-records", "clinical/clinical_records")


def layouts(listing: DataFrame) -> DataFrame:
    """(drop, root, export, cda, clinical_dir) of listing (drop, path): what a drop has, below its root."""
    root = F.when(F.startswith("path", F.lit("apple_health_export/")), "apple_health_export").otherwise(".")
    rel = F.regexp_replace("path", "^apple_health_export/", "")
    prio = F.array_position(F.array(*map(F.lit, CLINICAL_DIRS)), F.regexp_extract(rel, "^(.*)/[^/]+\\.json$", 1))
    rows = listing.select("drop", root.alias("root"), rel.alias("rel"), prio.alias("prio"))
    main = rows.where("rel = 'export.xml'").groupBy("drop").agg(F.min_by("root", F.when(F.col("root") == ".", 0).otherwise(1)).alias("root"))
    inside = rows.join(main, ["drop", "root"])
    best = F.min(F.when(F.col("prio") > 0, F.col("prio")))
    return inside.groupBy("drop", "root").agg(
        F.lit("export.xml").alias("export"),
        F.max(F.when(F.col("rel") == "export_cda.xml", F.col("rel"))).alias("cda"),
        F.try_element_at(F.array(*map(F.lit, CLINICAL_DIRS)), best.cast("int")).alias("clinical_dir"),
    )
