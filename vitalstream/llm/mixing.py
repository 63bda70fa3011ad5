"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key (the MD5 digest of its id and a seed). Within each source the key range is cut into
buckets of equal width, so no source, however large, has to fit one task; bucket totals give each bucket's offset and a
window inside the bucket gives each document's own prefix sum. The source's budget then cuts that order exactly: whole
epochs first, then the leading words of the key order.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, materialize


#: Keys that more than one in so many rows have are hot.
MOST_HOT = 1000


def targets(totals: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) of one row per source (source, source_size).

    Sources in code point order, null last, take the weights in turn and share `share` times all words by weight; a source
    stops at cap times its size and the excess goes to the others by weight. Sorted by cap * size / weight, the sources
    that stop come first, so prefix sums find the water level without a loop. One row per source meets in one task: the
    list of sources, not of documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("no", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    up = Window.orderBy(F.col("most") / F.col("w"), "no")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    filled = ranked.withColumn("level", level).withColumn("stops", F.col("level") * F.col("w") >= F.col("most"))
    first_open = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(
        up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    filled = filled.withColumn("water", first_open)
    target = F.when(F.col("water").isNull(), F.col("most")).otherwise(F.least("most", F.col("water") * F.col("w")))
    return filled.select("source", "source_size", target.alias("target"))


def hot_keys(sized: DataFrame, rows: int, bucket_rows: int) -> list[str]:
    """The keys that many rows share (rows without an id have one key), in order: at most MOST_HOT, whatever the data."""
    limit = max(bucket_rows, rows // MOST_HOT)
    if rows <= limit:
        return []
    often = sized.groupBy(F.xxhash64("mix_key").alias("h")).agg(F.count("*").alias("n"), F.min("mix_key").alias("mix_key")).where(F.col("n") > limit)
    return sorted(r.mix_key for r in often.select("mix_key").collect())


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7, bucket_rows: int = 20000, whole: bool = False, keep: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) and the columns keep of docs, one row per input row; of rows of one id
    and size the first of keep gives the order.

    size is the number of words of the text (null: 0). taken counts the words the mix takes, repeats included: the source's
    target, rounded to a word, is reached exactly, the document at the cut giving its leading words. With whole=True the
    document at the cut is taken whole if at least half of it lies within the budget, else not.
    Null sources are one source; null ids hash like ''. Rows with equal ids keep one place each in the order (ties by size,
    then any order). A source without words has target 0. An empty table gives an empty result. Other columns are ignored.
    """
    sized = materialize(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")).alias("mix_key"),
            F.pmod(F.xxhash64("text", F.spark_partition_id()), F.lit(256)).cast("string").alias("tie"),
            *keep,
        )
    )
    # The bucket width follows the row count only; a million buckets per source at most.
    rows = sized.count()
    digits = max(0, min(5, ceil(log2(max(1, rows / bucket_rows)) / 4)))
    bucket = F.substring("mix_key", 1, digits)
    if hot := hot_keys(sized, rows, bucket_rows):
        # The rows of a hot key have buckets of their own, by size and then by any order; other rows come before or behind.
        listed = F.array(*map(F.lit, hot))
        earlier = F.lpad(F.size(F.filter(listed, lambda k: k < F.col("mix_key"))).cast("string"), 4, "0")
        own = F.concat(F.lit("1"), F.lpad(F.col("size").cast("string"), 12, "0"), F.lpad("tie", 3, "0"))
        bucket = F.concat(bucket, earlier, F.when(F.array_contains(listed, F.col("mix_key")), own).otherwise("0"))
    sized = sized.withColumn("bucket", bucket).drop("tie")
    per_bucket = materialize(sized.groupBy("source", "bucket").agg(F.sum("size").alias("n")))
    goal = targets(per_bucket.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, cap)
    offsets = per_bucket.select(
        F.col("source").alias("b_source"),
        F.col("bucket").alias("b_bucket"),
        F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b_before"),
    )
    goal = goal.select(F.col("source").alias("g_source"), "source_size", "target")
    plan = offsets.join(goal, F.col("b_source").eqNullSafe(F.col("g_source"))).drop("g_source")
    kept = sized.columns[4:-1]
    rest = kept[:1]  # the same order in every run also among rows of one id
    inside = Window.partitionBy("source", "bucket").orderBy("mix_key", "doc_id", "size", *rest).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    budget = F.round("target").cast("long")
    size_of = F.greatest("source_size", F.lit(1))
    placed = placed.withColumn("before", F.col("before") + F.col("b_before")).withColumn("epochs", F.floor(budget / size_of))
    placed = placed.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    if whole:
        last = F.when(F.col("before") * 2 + F.col("size") <= F.col("rest") * 2, F.col("size")).otherwise(0)
    else:
        last = F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"), *kept)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as mix(whole=True) takes each of them: a document of one and a half epochs comes once or twice.

    Each row is taken by itself, whatever rows share its id. Documents without words are not in the mix. Rows are numbered and
    mixed without their texts, which meet their numbers in one join and so are shuffled once.
    """
    no, hashed, copies = free_names(docs, "mix_no", "mix_hash", "mix_times")
    numbered = materialize(docs.withColumn(no, F.monotonically_increasing_id()))
    whole = F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    found = mix(numbered, whole=True, keep=(whole.alias(hashed), F.col(f"`{no}`").alias(no)), **options)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0)).cast("int")
    often = found.select(no, times.alias(copies)).where(F.col(copies) > 0)
    return numbered.join(often, no).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same rules in SQL; {weights} etc. are the production parameters.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(COALESCE(CAST(doc_id AS VARCHAR), '') || ':7') AS k FROM documents),
totals AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS no FROM totals),
weighted AS (SELECT *, CASE no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS most FROM ranked),
levels AS (SELECT *, (1.5::DOUBLE * SUM(source_size) OVER () - COALESCE(SUM(most) OVER (ORDER BY most / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (SUM(w) OVER () - COALESCE(SUM(w) OVER (ORDER BY most / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM weighted),
water AS (SELECT arg_min(level, most / w) AS water FROM levels WHERE level * w < most),
goals AS (SELECT source, source_size, CASE WHEN water IS NULL THEN most ELSE least(most, water * w) END AS target FROM levels CROSS JOIN water),
placed AS (SELECT s.*, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS budget,
  COALESCE(CAST(SUM(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST((budget // greatest(source_size, 1)) * size + least(greatest(budget % greatest(source_size, 1) - before, 0), size) AS BIGINT) AS taken
FROM placed
"""
