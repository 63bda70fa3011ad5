"""Streams: replays, drops without files, and what a batch writes."""

import datetime as dt
import json

import pytest

from vitalstream.streaming import loads


@pytest.fixture
def folders(tmp_path):
    for name in ("drops", "table", "cursor"):
        (tmp_path / name).mkdir()
    (tmp_path / "table").rmdir()
    return tmp_path


def drop(folders, name, keys, day=1):
    lines = [json.dumps({"record_key": k, "canonical_person_id": "p", "event_time": f"2020-01-{day:02}T01:00:00Z", "value": 1.0}) for k in keys]
    (folders / "drops" / f"{name}.json").write_text("\n".join(lines) + "\n")


def load(spark, folders):
    loads.replay_safe(spark, str(folders / "drops"), str(folders / "table"), str(folders / "cursor"), files_per_batch=1)
    return sorted(r.record_key or "" for r in spark.read.schema(loads.DROP).parquet(str(folders / "table")).collect())


def test_replays_add_nothing(spark, folders):
    drop(folders, "a", ["k1", "k2", "k2", None])
    assert load(spark, folders) == ["", "k1", "k2"]
    drop(folders, "b", ["k2", "k1", None])
    assert load(spark, folders) == ["", "k1", "k2"]
    drop(folders, "c", ["k3", "k1"])
    assert load(spark, folders) == ["", "k1", "k2", "k3"]
    assert load(spark, folders) == ["", "k1", "k2", "k3"]


def test_state_is_on_disk_and_settings_come_back(spark, folders):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    drop(folders, "a", [f"k{i}" for i in range(500)])
    load(spark, folders)
    state = [p.name for p in (folders / "cursor" / "state").rglob("*") if p.suffix in (".changelog", ".zip")]
    assert state and spark.conf.get(key, None) == before


def counts(spark, folders):
    df = loads.daily_counts(spark, str(folders / "drops"), str(folders / "table"), str(folders / "cursor"))
    return {r.day: r.rows for r in df.collect()}


def files(folders):
    return {p: p.stat().st_mtime_ns for p in (folders / "table").rglob("part-*.parquet") if "day=" in str(p)}


def test_days_without_files(spark, folders):
    assert counts(spark, folders) == {}
    drop(folders, "a", ["k"], day=3)
    assert counts(spark, folders) == {dt.date(2020, 1, 3): 1}


def test_a_batch_writes_its_days_only(spark, folders):
    drop(folders, "a", ["k1", "k2"], day=1)
    drop(folders, "b", ["k3"], day=2)
    assert counts(spark, folders) == {dt.date(2020, 1, 1): 2, dt.date(2020, 1, 2): 1}
    before = files(folders)
    drop(folders, "c", ["k4", "k5"], day=2)
    drop(folders, "d", ["k6"], day=5)
    assert counts(spark, folders) == {dt.date(2020, 1, 1): 2, dt.date(2020, 1, 2): 3, dt.date(2020, 1, 5): 1}
    after = files(folders)
    kept = {p for p in before if "day=2020-01-01" in str(p)}
    assert kept and all(after.get(p) == before[p] for p in kept)
    assert counts(spark, folders) == {dt.date(2020, 1, 1): 2, dt.date(2020, 1, 2): 3, dt.date(2020, 1, 5): 1}
    assert files(folders) == after


def test_rows_without_time_have_no_day(spark, folders):
    (folders / "drops" / "a.json").write_text('{"record_key": "k"}\n')
    assert counts(spark, folders) == {}
