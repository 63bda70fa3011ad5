"""Canonical lines: every key of each source, JSON types kept, order over six keys, empty streams."""

import gzip
import hashlib
import json
import shutil
import time
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from vitalstream.plans import file_queries
from vitalstream.sources import canonical, tables

PEOPLE = "system string, value string, person string"


def resources(*given):
    return [(f"c/{i}.json", json.dumps(g) if isinstance(g, dict) else g) for i, g in enumerate(given)]


def lines(spark, rows, people=(), person=None):
    raw = spark.createDataFrame(rows, "file string, text string")
    return canonical.resource_lines(raw, spark.createDataFrame(list(people), PEOPLE), "r", person)


def test_a_resource_with_all_keys(spark):
    given = {
        "resourceType": "Observation",
        "id": "a",
        "subject": {"reference": "Patient/x"},
        "issued": "2020-01-02T03:04:05+01:00",
        "code": {"coding": [{"system": "z", "code": "1"}, {"system": "a", "code": "2"}, {"system": " ", "code": "3"}]},
        "valueQuantity": {"value": 1.5, "unit": "mg"},
        "status": "final",
    }
    (row,) = lines(spark, resources(given), [("fhir:id", "x", "px")]).collect()
    got = json.loads(row.line)
    key = got.pop("event_key")
    assert got.pop("record_key") == key == row.event_key
    assert hashlib.sha256(json.dumps(got, sort_keys=True, separators=(",", ":")).encode()).hexdigest() == key
    assert got == {
        "schema_version": 2,
        "canonical_person_id": "px",
        "source": "fhir",
        "source_file": "c/0.json",
        "event_time": "2020-01-02T02:04:05Z",
        "run_id": "r",
        "resource_type": "Observation",
        "source_id": "Observation/a",
        "code_coding": [{"code": "2", "system": "a"}, {"code": "1", "system": "z"}],
        "status": "final",
        "value": 1.5,
        "unit": "mg",
    }


def test_types_of_values_and_missing_keys(spark):
    values = ["7", 7, None, {"b": 1, "a": 'q"'}, True]
    given = [{"resourceType": "Observation", "valueQuantity": {"value": v}} for v in values] + [{"resourceType": "Condition", "code": {"coding": []}}, "[1]", "{", {"resourceType": "Patient"}]
    got = {r.source_file: json.loads(r.line) for r in lines(spark, resources(*given), person="only").collect()}
    assert [got[f"c/{i}.json"]["value"] for i in range(5)] == values
    base = {"schema_version", "canonical_person_id", "source", "source_file", "event_time", "run_id", "resource_type", "source_id", "event_key", "record_key"}
    assert set(got["c/5.json"]) == base and set(got["c/0.json"]) == base | {"value"}
    assert got["c/5.json"]["source_id"] is None and got["c/5.json"]["event_time"] is None and got["c/5.json"]["canonical_person_id"] == "only"
    assert len(got) == 6


def test_device_and_document_keys_are_kept_when_null(spark):
    device = spark.createDataFrame([("2020-01-01T00:00:00Z", "HKx", None, None)], "event_time string, hk_type string, value string, unit string")
    document = spark.createDataFrame([(None, "c", "1", None)], "event_time string, code string, value string, unit string")
    a, b = (json.loads(df.first().line) for df in (canonical.device_lines(device, "/private/export.xml", "r"), canonical.document_lines(document, "cda.xml", "r", "p")))
    assert a["value"] is None and a["unit"] is None and a["hk_type"] == "HKx" and a["source_file"] == "export.xml" and a["canonical_person_id"] == "unresolved"
    assert b["event_time"] is None and b["unit"] is None and b["code"] == "c" and b["canonical_person_id"] == "p"


def test_an_export_is_in_order_without_repeats_and_without_empty_streams(spark, tmp_path):
    path = str(tmp_path / "out")
    given = [{"resourceType": "Observation", "id": f"{i % 90}", "issued": f"20{i % 30 + 10}-01-01"} for i in range(300)]
    rows = [("same.json", json.dumps(g)) for g in given] + [("b.json", json.dumps({"resourceType": "Condition", "id": "k"}))]
    canonical.export(lines(spark, rows), path)
    assert sorted(p.name for p in Path(path).glob("stream=*")) == ["stream=conditions", "stream=documents", "stream=observations"]
    read = [json.loads(x) for p in sorted(Path(path).glob("stream=observations/part-*")) for x in p.read_text().splitlines()]
    order = [tuple(r[k] or "" for k in canonical.SIX_KEYS) for r in read]
    assert order == sorted(order) and len(order) == 90
    assert spark.read.text(f"{path}/stream=documents").isEmpty()


def test_an_empty_export(spark, tmp_path):
    path = str(tmp_path / "out")
    canonical.export(lines(spark, []), path)
    assert sorted(p.name for p in Path(path).glob("stream=*")) == ["stream=documents", "stream=observations"]


def test_sources_are_put_by_one_after_another(spark, tmp_path):
    """What a source was read from may go before the next is asked for; the lines of all are in one order, without repeats."""
    path, gone = str(tmp_path / "out"), []

    def sources():
        for i in range(2):
            raw = tmp_path / f"raw{i}"
            rows = [(f"{i}.json", json.dumps({"resourceType": "Observation", "id": f"{k % 40}", "issued": f"20{k % 30 + 10}-01-01"})) for k in range(200)]
            spark.createDataFrame(rows, "file string, text string").write.parquet(str(raw))
            yield canonical.resource_lines(spark.read.parquet(str(raw)), spark.createDataFrame([], PEOPLE), "r")
            shutil.rmtree(raw)
            gone.append(i)

    canonical.export(sources(), path, "gzip")
    parts = sorted(Path(path).glob("stream=observations/part-*"))
    read = [json.loads(x) for p in parts for x in gzip.decompress(p.read_bytes()).decode().splitlines()]
    order = [tuple(r[k] or "" for k in canonical.SIX_KEYS) for r in read]
    assert gone == [0, 1] and len(order) == len(set(order)) == 240 and order == sorted(order)
    for r in read:
        key = r.pop("event_key")
        assert r.pop("record_key") == key == hashlib.sha256(json.dumps(r, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_the_query_leaves_its_export_alone_on_disk(spark):
    """Raw files and lines that were put by are gone; the export takes far less than its lines, whose hashes don't compress."""
    shared = Path(tables.shared_folder(spark).removeprefix("file:"))
    before = set(shared.iterdir()) if shared.exists() else set()
    lines = file_queries.canonical_export(spark, "/root/testdata/sf0.001").collect()
    (left,) = set(shared.iterdir()) - before
    on_disk = sum(p.stat().st_size for p in left.rglob("part-*"))
    assert left.name.startswith("canonical-") and on_disk < sum(len(r.line) for r in lines) / 3


def test_shuffle_files_go_with_their_write(spark, tmp_path):
    """A source's shuffles would else lie beside those of all others."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    kept = lambda: {p.name for d in dirs for p in Path(d).rglob("shuffle_*.data")}
    before = kept()
    with tables.shuffles_dropped(spark):
        given = spark.range(1000).withColumn("k", F.col("id") % 7)
        given.join(given.groupBy("k").count(), "k").repartition(3, "id").write.parquet(str(tmp_path / "out"))
    until = time.time() + 5
    while kept() - before and time.time() < until:
        time.sleep(0.1)
    assert not kept() - before and spark.conf.get(key, "false") == "false" and spark.read.parquet(str(tmp_path / "out")).count() == 1000


def test_lines_of_many_small_files_are_shuffled_by_few_tasks(spark, tmp_path):
    """A row or two from each task to each partition don't compress."""

    def task(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(b), pa.string()), pa.array([str(TaskContext.get().partitionId())] * len(b), pa.string()), pa.array(map(str, b.column(0).to_pylist()), pa.string())], ["event_time", "code", "value"])

    small = spark.range(0, 300, 1, 100).mapInArrow(task, "event_time string, code string, value string").withColumn("unit", F.lit(None).cast("string"))
    canonical.export(canonical.document_lines(small, "cda.xml", "r"), str(tmp_path / "out"))
    read = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out/stream=observations").collect()]
    assert len({r["value"] for r in read}) == len(read) == 300 and len({r["code"] for r in read}) <= 8
