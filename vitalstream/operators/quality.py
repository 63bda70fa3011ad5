"""Validation of canonical JSON lines. Every rule is a DataFrame of errors (file, line_no, code, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The required keys, all strings but the last, which is an integer.
REQUIRED = ("canonical_person_id", "source", "source_file", "event_time", "run_id", "record_key", "schema_version")
BLANK = r"(?U)^\s*$"


def _errors(rows: DataFrame, code: str, detail: Column) -> DataFrame:
    return rows.select("file", "line_no", F.lit(code).alias("code"), detail.alias("detail"))


def _listed(rows: DataFrame, errors: Column) -> DataFrame:
    return rows.select("file", "line_no", F.explode(F.array_compact(errors)).alias("x")).select("file", "line_no", "x.code", "x.detail")


def _error(code: str | Column, detail: str = "") -> Column:
    return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(detail).alias("detail"))


def no_files(drops: DataFrame, files: DataFrame) -> DataFrame:
    """drops (file) that have no *.ndjson among files (drop, path)."""
    with_lines = files.where(F.col("path").endswith(".ndjson")).select(F.col("drop").alias("file")).distinct()
    return _errors(drops.join(with_lines, "file", "left_anti").withColumn("line_no", F.lit(0).cast("long")), "no_ndjson_files", F.lit(""))


def missing_newline(files: DataFrame) -> DataFrame:
    """files (file, content): not empty and without a final newline."""
    bad = files.where((F.length("content") > 0) & ~F.col("content").endswith("\n")).withColumn("line_no", F.lit(0).cast("long"))
    return _errors(bad, "missing_trailing_newline", F.lit(""))


def empty_lines(lines: DataFrame) -> DataFrame:
    """Lines of white space only, tabs included."""
    return _errors(lines.where(F.col("line").rlike(BLANK)), "empty_line", F.lit(""))


def _banned(tokens: list[str], patterns: list[str]) -> list[Column]:
    return [F.when(F.contains("line", F.lit(t)), _error("banned_token", t)) for t in tokens] + [F.when(F.col("line").rlike(p), _error("banned_pattern", p)) for p in patterns]


def banned(lines: DataFrame, tokens: list[str], patterns: list[str]) -> DataFrame:
    """An error for each token in and each pattern found in a line that is not blank; one pass, a row per finding."""
    return _listed(lines.where(~F.col("line").rlike(BLANK)), F.array(*_banned(tokens, patterns)))


def _parsed(lines: DataFrame) -> DataFrame:
    """lines with v, the parsed line. It comes out of a generator, so that the plan parses once however often v is used."""
    return lines.select("file", "line_no", "line", F.explode(F.array(F.try_parse_json("line"))).alias("v"))


def _is_object() -> Column:
    return F.col("v").isNotNull() & F.schema_of_variant("v").like("OBJECT%")


def _bad_json() -> Column:
    return F.when(F.col("v").isNull(), _error("invalid_json")).when(~F.schema_of_variant("v").like("OBJECT%"), _error("not_object"))


def _required() -> Column:
    """The errors of an object's required keys; the shape of each is looked up once."""
    shape = lambda key: F.schema_of_variant(F.try_variant_get("v", f"$.{key}", "variant"))
    shapes = F.array(*[F.struct(F.lit(key).alias("key"), shape(key).alias("shape")) for key in REQUIRED])
    fine = lambda x: F.when(x["key"] == "schema_version", x["shape"].isin("BIGINT", "BOOLEAN")).otherwise(x["shape"] == "STRING")
    bad = F.filter(shapes, lambda x: x["shape"].isNull() | ~fine(x))
    return F.transform(bad, lambda x: F.struct(F.when(x["shape"].isNull(), "missing_required_key").otherwise("invalid_type").alias("code"), x["key"].alias("detail")))


def bad_json(lines: DataFrame) -> DataFrame:
    return _listed(_parsed(lines.where(~F.col("line").rlike(BLANK))), F.array(_bad_json()))


def required_keys(lines: DataFrame) -> DataFrame:
    """missing_required_key and invalid_type of the lines that are objects."""
    return _listed(_parsed(lines.where(~F.col("line").rlike(BLANK))).where(_is_object()), _required())


def all_errors(lines: DataFrame, tokens: list[str], patterns: list[str]) -> DataFrame:
    """Every line error, by file, line, code and detail: each line is read and parsed once."""
    keys = F.when(_is_object(), _required()).otherwise(F.array(_bad_json()))
    found = F.when(F.col("line").rlike(BLANK), F.array(_error("empty_line"))).otherwise(F.concat(F.array(*_banned(tokens, patterns)), keys) if tokens or patterns else keys)
    return _listed(_parsed(lines), found).orderBy("file", "line_no", "code", "detail")
