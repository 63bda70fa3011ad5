"""Keyed operators: person lookup, append-if-absent, keep-first, reconciliation, pseudonym numbers, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def keep_first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the first by order. min_by with map-side combine, so a hot key never meets in one task as rows."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return first.select(key, *[F.col(f"first.{c}").alias(c) for c in rest]).select(*rows.columns)


def append_if_absent(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """old and the first row of each key of new that old has not."""
    return old.unionByName(keep_first(new, key, *order).join(old.select(key), key, "left_anti"))


def resolve_person(rows: DataFrame, people: DataFrame, default: str | None = None) -> DataFrame:
    """rows (system, value, ...) with canonical_person_id from people (system, value, person): else the default, else unresolved.

    people must have one row per (system, value). Whether it is broadcast is left to its measured size.
    """
    found = F.coalesce("person", *([F.lit(default)] if default else []), F.lit("unresolved"))
    return rows.join(people, ["system", "value"], "left").withColumn("canonical_person_id", found).drop("person")


def reconcile(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state): full outer join of manifest rows and files (path, size, sha256)."""
    a, b = listed.alias("a"), actual.alias("b")
    state = (
        F.when(F.col("b.path").isNull(), "missing")
        .when(F.col("a.path").isNull(), "extra")
        .when(F.col("a.size") != F.col("b.size"), "size_mismatch")
        .when(F.col("a.sha256") != F.col("b.sha256"), "hash_mismatch")
        .otherwise("ok")
    )
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), state.alias("state"))


def path_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, path) of the paths of one side only."""
    only = lambda x, y, side: x.join(y, "path", "left_anti").select(F.lit(side).alias("side"), "path").distinct()
    return only(left.select("path"), right.select("path"), "left").unionByName(only(right.select("path"), left.select("path"), "right"))


def fingerprint(files: DataFrame, by: str, line: Column) -> DataFrame:
    """(by, sha256, file_count, total_bytes): the hash over a group's lines, in order of their paths.

    files has path and size. Paths fall into 4096 parts by their hash; a part's hash is over its lines in order, the group's
    over the hashes of its parts. So a row holds a 4096th of a group's lines, or 4096 hashes.
    """
    parts = files.groupBy(by, F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 3).alias("part")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), "").cast("binary"), 256).alias("part_sha"),
        F.count("*").alias("n"),
        F.sum("size").alias("total"),
    )
    return parts.groupBy(by).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "part_sha"))), lambda x: x["part_sha"]), "").cast("binary"), 256).alias("sha256"),
        F.sum("n").alias("file_count"),
        F.sum("total").alias("total_bytes"),
    )


def default_person(people: DataFrame) -> str | None:
    """The only person of people (person), if there is exactly one: two rows at most come to the driver."""
    known = people.where("person is not null").select("person").distinct().limit(2).collect()
    return known[0].person if len(known) == 1 else None


def plan_runs(runs: DataFrame, inputs: DataFrame, order: str) -> DataFrame:
    """(input_id, parent_run_id, run_id, state) for inputs (input_id, sha256, since, expected_run_id) after runs (run_id, sha256, order).

    The parent is the run named by since, else the last one by order. An input whose fingerprint is its parent's changes
    nothing and keeps the parent's id (no_change); else the id derives from parent and fingerprint (run). Where another id
    was expected the state is unexpected_run_id.
    """
    last = runs.agg(F.max_by("run_id", order)).first()[0]
    placed = inputs.withColumn("parent_run_id", F.coalesce("since", F.lit(last).cast("string")))
    parents = runs.select(F.col("run_id").alias("parent_run_id"), F.col("sha256").alias("parent_sha256"))
    found = placed.join(parents, "parent_run_id", "left").withColumn("same", F.coalesce(F.col("sha256") == F.col("parent_sha256"), F.lit(False)))
    found = found.withColumn("run_id", F.when(F.col("same"), F.col("parent_run_id")).otherwise(run_id(F.col("parent_run_id"), F.col("sha256"))))
    state = F.when(F.col("expected_run_id") != F.col("run_id"), "unexpected_run_id").when(F.col("same"), "no_change").otherwise("run")
    return found.select("input_id", "parent_run_id", "run_id", state.alias("state"))


def bundle_entries(runs: DataFrame, artifacts: DataFrame, dirs: tuple[str, ...]) -> DataFrame:
    """What a bundle says of its runs: their fingerprint, without notes, and those of their artifacts (run_id, name, path) that
    lie in one of the bundle's folders."""
    shared = artifacts.where(F.concat_ws("/", "run_id", F.split("path", "/")[1]) == F.substring_index("path", "/", 2)).where(F.split("path", "/")[1].isin(*dirs))
    return runs.select("run_id", "parent_run_id", "sha256", "file_count", "total_bytes").join(shared, "run_id")


def run_id(parent: Column, sha256: Column, salt: str = "vitalstream-run") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(salt), F.coalesce(parent, F.lit("")), sha256).cast("binary"), 256)


def register_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """runs with the rows of new whose run_id is not registered yet; idempotent."""
    return runs.unionByName(new.dropDuplicates(["run_id"]).join(runs.select("run_id"), "run_id", "left_anti"))


def detect_no_change(runs: DataFrame) -> DataFrame:
    """(run_id, no_change): a run whose fingerprint equals its parent's."""
    parent = runs.select(F.col("run_id").alias("parent_run_id"), F.col("sha256").alias("parent_sha256"))
    return runs.join(parent, "parent_run_id", "left").select("run_id", F.coalesce(F.col("sha256") == F.col("parent_sha256"), F.lit(False)).alias("no_change"))


def apply_deletes(rows: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    return rows.join(deletes.select(key), key, "left_anti")


def numbered(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """df with its place from 1 in the order of keys, which must be a total order.

    Rows are dealt out by ranges of the keys and written with their range's number; a place is the sum of the earlier
    ranges' counts and the number inside the range. Only one count per range meets in one task.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(ranges, *keys).withColumn("range_no", F.spark_partition_id()))
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("range_no").agg(F.count("*").alias("rows_in_range"))
    before = counts.select("range_no", F.coalesce(F.sum("rows_in_range").over(earlier), F.lit(0)).alias("rows_before"))
    inside = F.row_number().over(Window.partitionBy("range_no").orderBy(*keys))
    return dealt.withColumn("inside", inside).join(before, "range_no").withColumn(column, F.col("rows_before") + F.col("inside")).drop("range_no", "rows_before", "inside")


def pseudonym_labels(people: DataFrame) -> DataFrame:
    """people (person_key, last, first) with label `Patient N`, numbered by (last, first, key)."""
    placed = numbered(people.select("person_key", "first", "last"), "n", "last", "first", "person_key")
    return placed.select("person_key", "first", "last", F.concat(F.lit("Patient "), F.col("n").cast("string")).alias("label"))


def collisions(rows: DataFrame) -> DataFrame:
    """(run_id, first, last, hits) of names that occur more than once in a run."""
    return rows.groupBy("run_id", "first", "last").agg(F.count("*").alias("hits")).where("hits > 1")
