"""Secret scans with DataFrame functions only: three fixed patterns and a pair of character Markov models.

The models are first-order chains over characters, one of random strings and one of ordinary identifiers; a candidate
string is reported if its log-likelihood ratio per character passes a threshold. They are trained from labelled samples
that the corpus gives itself: values that the fixed patterns find, and letter-only identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialize

#: Fixed values of the contract: kind, pattern, least length, and the group whose length counts.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
)
#: What need not be matched in full: a cheap test that a text has a match long enough.
SIEVE = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24}",
}
#: Candidates of the models: whole runs of these characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Ordinary identifiers, the negative sample: letters, joined or not.
IDENTIFIER = r"^[A-Za-z]+([_-][A-Za-z]+)*$"


STEPS = "array<struct<no:int,pos:int,gap:int,own:int,value:string>>"


def steps(text: Column, pattern: str, group: int, no: int) -> Column:
    """The matches of pattern as STEPS: each with the length of the text between the match before and it, its own length and
    the value of its group. The text between the matches (split) and the matches add up to the text."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(F.sequence(F.lit(1), F.size(whole)).alias("pos"), gaps.alias("gap"), F.transform(whole, F.length).alias("own"), value.alias("value"))
    listed = F.filter(zipped, lambda m: m["own"].isNotNull())
    return F.when(F.size(whole) > 0, F.transform(listed, lambda m: F.struct(F.lit(no).alias("no"), m["pos"].alias("pos"), m["gap"].alias("gap"), m["own"].alias("own"), m["value"].alias("value"))))


def found_steps(text: Column) -> Column:
    """The matches of all fixed patterns and the models' candidates, as one array of STEPS."""
    parts = []
    for no, (kind, pattern, _, group) in enumerate(KINDS):
        if kind == "hex":
            # Only runs of 24 and more can pass, and a run is a match of its own: the short ones need not be listed.
            pattern = r"(?<![0-9a-f])[0-9a-f]{24,}+"
        parts.append(F.when(text.rlike(SIEVE[kind]), steps(text, pattern, group, no)))
    parts.append(F.when(text.rlike(CANDIDATE), steps(text, CANDIDATE, 0, len(KINDS))))
    return F.concat(*[F.coalesce(p, F.array()).cast(STEPS) for p in parts])


SPANS = "array<struct<start:int,no:int,end:int,kind:string,value:string>>"


def placed_spans(found: DataFrame) -> DataFrame:
    """(row_key, start, no, end, value) of found (row_key, steps): base matches that pass, and candidates that overlap none.

    Places are running sums over a text's matches in order, and overlaps are told by running extremes over its spans, so a
    text costs what its matches cost however many it has.
    """
    listed = found.where(F.size("steps") > 0).select("row_key", F.explode("steps").alias("m")).select("row_key", "m.*")
    end = F.sum(F.col("gap") + F.col("own")).over(Window.partitionBy("row_key", "no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    least = F.element_at(F.array(*[F.lit(k[2]) for k in KINDS], F.lit(20)), F.col("no") + 1)
    placed = listed.withColumn("end", end).withColumn("start", F.col("end") - F.col("own")).where(F.length("value") >= least)
    base = F.col("no") < len(KINDS)
    # Both windows run from their first row on: a frame that ends with the last row is computed anew for each row.
    seen = lambda *order: Window.partitionBy("row_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.max(F.when(base, F.col("end"))).over(seen("start", "no"))
    behind = F.min(F.when(base, F.col("start"))).over(seen(F.desc("start"), F.desc("no")))
    marked = placed.withColumn("before", before).withColumn("behind", behind)
    clear = ~(F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("behind") < F.col("end"), F.lit(False)))
    return marked.where(base | clear).select("row_key", "start", "no", "end", "value")


#: The characters that candidates are made of.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def markov_model(samples: DataFrame, smoothing: float = 4.0) -> DataFrame:
    """(pair, ratio) from samples (label, value): the log ratio of P(second | first) under label 1 to that under label 0.

    One row for each of the 68 * 67 pairs (^ stands for the start). Either chain backs off to its characters' own
    frequencies, and those to equal ones, by the same smoothing weight.
    """
    chars = F.concat(F.lit("^"), F.col("value"))
    pairs = samples.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("value")), lambda i: F.substring(chars, i, F.lit(2)))).alias("pair"))
    counts = pairs.groupBy("pair").agg(*[F.sum((F.col("label") == k).cast("long")).alias(f"n{k}") for k in (0, 1)])
    letters = list(ALPHABET)
    grid = samples.sparkSession.createDataFrame([(f, letters) for f in ["^", *letters]], "f string, seconds array<string>")
    grid = grid.select("f", F.explode("seconds").alias("s")).withColumn("pair", F.concat("f", "s")).join(counts, "pair", "left")
    first, second, every = Window.partitionBy("f"), Window.partitionBy("s"), Window.partitionBy(F.lit(1))
    logs = []
    for k in (0, 1):
        n = F.coalesce(F.col(f"n{k}"), F.lit(0))
        alone = (F.sum(n).over(second) + smoothing) / (F.sum(n).over(every) + smoothing * len(letters))
        logs.append(F.log((n + smoothing * alone) / (F.sum(n).over(first) + smoothing)))
    return grid.select("pair", (logs[1] - logs[0]).alias("ratio"))


def secret_spans(docs: DataFrame, sample_rows: int = 20000, threshold: float = 0.5, keep: tuple[Column, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (doc_id, keep..., row_key), one per row of docs, and spans (row_key, start, no, end, value) of the
    fixed patterns and of the candidates that the models take for random strings."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", *keep, found_steps(text).alias("steps")).withColumn("row_key", F.expr("uuid()"))
    found = materialize(found)
    placed = materialize(placed_spans(found))
    base = F.col("no") < len(KINDS)
    positive = placed.where(base).select("value").where("length(value) >= 16 and value rlike '^[A-Za-z0-9+/_=-]+$'")
    negative = placed.where(~base).select("value").where(F.col("value").rlike(IDENTIFIER))
    pick = lambda df, label: df.distinct().orderBy(F.xxhash64("value"), "value").limit(sample_rows).select(F.lit(label).alias("label"), "value")
    model = materialize(markov_model(pick(positive, 1).unionByName(pick(negative, 0))))
    # Equal candidates have one score.
    chars = F.concat(F.lit("^"), F.col("value"))
    tried = placed.where(~base).select("value").distinct()
    pairs = tried.select("value", F.explode(F.transform(F.sequence(F.lit(1), F.length("value")), lambda i: F.substring(chars, i, F.lit(2)))).alias("pair"))
    scored = pairs.join(model, "pair", "left").groupBy("value").agg(F.avg(F.coalesce("ratio", F.lit(0.0))).alias("llr"))
    random = scored.where(F.col("llr") > threshold).select("value")
    return found.drop("steps"), placed.where(base).unionByName(placed.where(~base).join(random, "value", "left_semi").select(*placed.columns))


def scan(docs: DataFrame, keep: tuple[Column, ...] = (), **options) -> DataFrame:
    """docs' doc_id, and the columns keep of docs, with base and spans: arrays of struct(start, no, end, kind, value) sorted by start, then kind.

    base holds the fixed patterns' matches; spans adds (kind `markov`) each candidate that overlaps none of them and
    whose mean log-likelihood ratio per character is above threshold. The models are fitted on at most sample_rows strings
    of either label, the least by hash of all; every text is scanned whole. A null text has no spans. Rows keep their
    number, repeated rows included; an empty table gives none. Without samples of both labels there are no markov spans.
    """
    rows, spans = secret_spans(docs, keep=keep, **options)
    kind = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS], F.lit("markov")), F.col("no") + 1)
    by_row = spans.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "no", "end", kind.alias("kind"), "value"))).alias("spans"))
    every = F.coalesce("spans", F.array().cast(SPANS))
    out = rows.join(by_row, "row_key", "left").select(*rows.columns[:-1], every.alias("spans"))
    return out.select(*rows.columns[:-1], F.filter("spans", lambda s: s["no"] < len(KINDS)).alias("base"), "spans")


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """The digest of scan(): counts by kind, the SHA-256 of the base spans, all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(docs, **options).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k, *_ in KINDS], F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans")
    )


def redact(docs: DataFrame, mask: str = "[secret]", **options) -> DataFrame:
    """docs with every span of scan() replaced by mask; overlapping spans become one mask. Texts without spans stay as they are.

    Spans come back to rows by id (null too) and digest of the text, so rows under one id are cut each by its own spans. What
    stays between spans is cut from the text as UTF-32, where a place is an offset, so long texts cost no more by the span.
    """
    columns = docs.columns
    key, digest, found = free_names(docs, "secret_key", "secret_text", "secret_spans")
    own = F.md5(F.col("text").cast("binary"))
    rows, spans = secret_spans(docs, keep=(own.alias(digest),), **options)
    order = Window.partitionBy("row_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    cuts = spans.withColumn("from", F.coalesce(F.max("end").over(order), F.lit(0)))
    by_row = cuts.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "from"))).alias(found))
    by_text = rows.join(by_row, "row_key").select(F.col("doc_id").alias(key), digest, found).dropDuplicates([key, digest])
    joined = docs.join(by_text, docs["doc_id"].eqNullSafe(by_text[key]) & (F.md5(docs["text"].cast("binary")) == by_text[digest]), "left")

    def cleaned(w: Column) -> Column:
        """w: (wide, spans) as a lambda's argument, so that the text is encoded once and not once a span."""
        between = lambda a, z: F.decode(F.substring(w["wide"], 4 * a + 1, 4 * (z - a)), "UTF-32")
        parts = F.transform(F.filter(w["spans"], lambda s: s["start"] >= s["from"]), lambda s: F.concat(between(s["from"], s["start"]), F.lit(mask)))
        last = F.array_max(F.transform(w["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), between(last, F.octet_length(w["wide"])))

    one = F.transform(F.array(F.struct(F.encode("text", "UTF-32").alias("wide"), F.col(found).alias("spans"))), cleaned)[0]
    return joined.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(one)).select(*[F.col(f"`{c}`") for c in columns])
