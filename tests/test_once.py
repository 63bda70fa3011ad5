"""What is read or worked out several times is worked out once; texts that hold no name are not taken apart."""

import pytest

from vitalstream.operators import names, privacy
from vitalstream.plans import file_queries, job_queries
from vitalstream.sources import clinical, sinks

SF = "/root/testdata/sf0.001"


def test_hits_are_walked_once(spark, tmp_path):
    """The walk is taken by several joins; each would walk all resources anew."""
    walked, walk = [], clinical.walk
    seen = spark.sparkContext.accumulator(0)

    def counted(raw, kinds=None):
        walked.append(kinds)

        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return walk(raw.select("file", "text").mapInArrow(run, "file string, text string"), kinds)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(clinical, "walk", counted)
        done = job_queries.finished_job(spark, SF, str(tmp_path / "job"))
    assert len(walked) == 1 and seen.value == done["staged"].count() > 0


def test_current_events_are_shuffled_once(spark, tmp_path):
    plan = sinks.current_events(sinks.stream_events(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_texts_without_names_stay(monkeypatch):
    people = names.Names([(1, "Ann", "Lee", "Patient 1")])
    assert people.redact("Saw ann  LEE, lee, Ann; Ann") == "Saw Patient 1, Patient 1; Ann"
    monkeypatch.setattr(names, "_Chain", lambda *_: pytest.fail("taken apart"))
    monkeypatch.setattr(privacy.json, "loads", lambda *_: pytest.fail("parsed"))
    assert people.redact("no name in it") == "no name in it"
    assert privacy.redact_patient('{"resourceType":"Observation"}', "Patient 1") == '{"resourceType":"Observation"}'


def test_export_and_event_stream_use_every_task(spark, tmp_path, monkeypatch):
    """Few bytes of lines are much work too: the ranges are as many as the session shuffles to."""
    given = []
    kind = type(spark.range(1))
    ranged = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda df, *a: given.append(a[0]) or ranged(df, *a))
    file_queries.canonical_export(spark, SF)
    file_queries.partitioned_events(spark, SF)
    assert given == [8, 8]
