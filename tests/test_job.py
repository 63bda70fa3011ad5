"""Runs in stages: taken up where they broke off, nothing half written, registered last."""

import pytest
from pyspark.sql import functions as F

from vitalstream.operators import job
from vitalstream.plans import job_queries


class Broken(Exception):
    pass


def stages(calls, fail_at=None):
    def stage(name, work):
        def run(done):
            calls.append(name)
            if name == fail_at:
                raise Broken
            return work(done)

        return name, run

    return lambda spark: [
        stage("a", lambda done: spark.range(10)),
        stage("b", lambda done: done["a"].where("id % 2 = 0")),
        stage("c", lambda done: done["b"].withColumn("x", F.col("id") * 2)),
        stage("d", lambda done: done["c"].agg(F.sum("x").alias("total"))),
    ]


def events(spark, root):
    return [(r.stage, r.state, r.rows) for r in job.stage_events(spark, root).orderBy("seconds").collect()]


def test_a_broken_run_is_taken_up(spark, tmp_path):
    root, calls = str(tmp_path / "job"), []
    with pytest.raises(Broken):
        job.run(spark, root, "r1", "f", stages(calls, "d")(spark))
    assert calls == ["a", "b", "c", "d"] and job.runs(spark, root).isEmpty()
    again = []
    done = job.run(spark, root, "r1", "f", stages(again)(spark))
    assert again == ["d"] and done["d"].first().total == 40
    assert sorted(events(spark, root)) == [("a", "kept", 10), ("a", "run", 10), ("b", "kept", 5), ("b", "run", 5), ("c", "kept", 5), ("c", "run", 5), ("d", "run", 1)]
    assert [(r.run_id, r.sha256) for r in job.runs(spark, root).collect()] == [("r1", "f")]


def test_other_input_runs_anew_and_a_rerun_does_nothing(spark, tmp_path):
    root, calls = str(tmp_path / "job"), []
    job.run(spark, root, "r1", "f", stages(calls)(spark))
    job.run(spark, root, "r1", "f", stages(calls)(spark))
    job.run(spark, root, "r2", "g", stages(calls)(spark), parent="r1")
    assert calls == ["a", "b", "c", "d"] * 2
    assert sorted((r.run_id, r.parent_run_id) for r in job.runs(spark, root).collect()) == [("r1", None), ("r2", "r1")]
    row = job.report(spark, root).where("run_id = 'r2'").first()
    assert row.registered and row.stages == 4 and row.a_rows == 10 and row.d_executed


def test_a_stage_that_fails_while_writing_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "job")
    bad = [("a", lambda done: spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("id")))]
    with pytest.raises(Exception, match="no"):
        job.run(spark, root, "r", "f", bad)
    done = job.run(spark, root, "r", "f", [("a", lambda done: spark.range(4))])
    assert done["a"].count() == 4


def test_the_whole_job_chains(spark, tmp_path):
    """Names of the resources' patients reach no later stage; persons found by identity are those of the streams."""
    done = job_queries.finished_job(spark, "/root/testdata/sf0.001", str(tmp_path / "job"))
    assert done["staged"].where("text like '%Lee%'").count() > 0
    assert done["redacted"].where("text rlike 'Ann\\\\d+|Lee\\\\d|1980'").count() == 0
    known = {r.person_key for r in done["identity"].collect()}
    used = {r.canonical_person_id for r in done["tables"].collect()} - {"unresolved"}
    assert used and used <= known
