"""Tables of few bytes that stand for much work are dealt over tasks before the work."""

from vitalstream.plans import file_queries, quality_queries, report_queries
from vitalstream.sources import clinical

SF = "/root/testdata/sf0.001"


def tasks(df):
    return df.rdd.getNumPartitions()


def test_resources_are_dealt(spark):
    assert tasks(clinical.raw_resources(spark, SF)) == 8
    assert tasks(clinical.walk(clinical.raw_resources(spark, SF))) == 8


def test_texts_of_parts_are_dealt(spark):
    assert tasks(quality_queries.redact_cda(spark, SF)) == 8
    assert tasks(quality_queries.QUERIES["redact_names"](spark, SF)) == 8


def test_names_of_documents(spark):
    """Inner text counts, the first of several does, and what is missing is empty."""
    full = '<d xmlns="urn:x"><o><patient><name><g>A</g> B</name><name>C</name></patient></o><birthTime/><birthTime value="1"/><author><name>D</name></author></d>'
    rows = quality_queries.cda_names(spark.createDataFrame([(1, full), (2, "<d/>")], "p_partkey long, text string")).collect()
    assert sorted(map(tuple, rows)) == [(1, "A B", "", "1", "D"), (2, "", "", "", "")]


def test_files_are_written_by_many_tasks(spark):
    """Documents of few bytes are files of their own; one task would write them one after the other."""
    root = file_queries.cda_folder(spark, "/root/testdata/sf0.01")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path").collect()
    assert len(files) == 50
    assert len({r.path.rsplit("/", 1)[1].split("-")[1] for r in files}) > 1


def test_medications_are_not_sent_everywhere(spark):
    plan = report_queries.totalled(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
