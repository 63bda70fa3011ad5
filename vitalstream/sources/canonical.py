"""Canonical lines: the rows of all sources with every key of theirs, named by their content, in one export.

A line is compact JSON with its keys in name order. Keys that a source always has are written even when they are NULL; a
clinical resource leaves out codings, value, unit and status where it has none. The event key is the SHA-256 of the line
without keys, and the record key is the same.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CODINGS, redact_path
from ..operators.job import exists
from ..operators.keyed import resolve_person
from .clinical import resource_rows
from .sinks import SIX_KEYS
from .tables import drop_folder, new_folder

SCHEMA_VERSION = 2
#: The six keys without the one that is made of the line itself, and what a line is made of: its members before event_key,
#: between it and record_key, and after it.
GIVEN_KEYS = tuple(k for k in SIX_KEYS if k != "event_key")
PIECES = ("head", "middle", "tail")
#: The streams that an export has even when they are empty.
ALWAYS = ("observations", "documents")


def members(kept: dict[str, Column], optional: dict[str, Column], ready: dict[str, Column]) -> Column:
    """The members of a JSON object in name order, without braces: kept ones even if NULL, optional ones and ready JSON if not."""
    kind = dict.fromkeys(kept, "kept") | dict.fromkeys(optional, "optional") | dict.fromkeys(ready, "ready")
    parts = []
    for how, names in groupby(sorted(kind), kind.get):
        if how == "ready":
            parts += [F.concat(F.lit(f'"{n}":'), ready[n]) for n in names]
            continue
        given = kept if how == "kept" else optional
        text = F.to_json(F.struct(*[given[n].alias(n) for n in names]), {"ignoreNullFields": str(how == "optional").lower()})
        parts.append(F.nullif(F.regexp_replace(text, r"^\{|\}$", ""), F.lit("")))
    return F.nullif(F.concat_ws(",", *parts), F.lit(""))


def _braced(*parts: Column | str) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _event_key() -> Column:
    return F.sha2(_braced(*PIECES).cast("binary"), 256)


def _line() -> Column:
    """The line of the pieces and event_key."""
    key = lambda name: F.concat(F.lit(f'"{name}":"'), F.col("event_key"), F.lit('"'))
    return _braced(F.col("head"), key("event_key"), F.col("middle"), key("record_key"), F.col("tail"))


def keyed_lines(rows: DataFrame, kept: dict[str, Column], optional: dict[str, Column] | None = None, ready: dict[str, Column] | None = None) -> DataFrame:
    """(stream, the six sort keys, the line's pieces, line) of rows with stream; the members are written once and put together twice."""
    given = (kept, optional or {}, ready or {})
    between = lambda low, high: members(*[{n: c for n, c in g.items() if low < n < high} for g in given])
    every = kept | (optional or {})
    sort = [every.get(k, F.lit(None)).cast("string").alias(k) for k in GIVEN_KEYS]
    parts = rows.select("stream", *sort, between("", "event_key").alias("head"), between("event_key", "record_key").alias("middle"), between("record_key", "~").alias("tail"))
    return parts.withColumn("event_key", _event_key()).select("stream", *SIX_KEYS, *PIECES, _line().alias("line"))


def _common(source: str, person: Column, file: Column, run_id: str) -> dict[str, Column]:
    return {
        "schema_version": F.lit(SCHEMA_VERSION),
        "canonical_person_id": person,
        "source": F.lit(source),
        "source_file": redact_path(file),
        "event_time": F.col("event_time"),
        "run_id": F.lit(run_id),
    }


def device_lines(records: DataFrame, file: str, run_id: str, person: str | None = None) -> DataFrame:
    """Lines of device records (event_time, hk_type, value, unit): observations of the default person, if there is one."""
    common = _common("healthkit", F.lit(person or "unresolved"), F.lit(file), run_id)
    return keyed_lines(records.withColumn("stream", F.lit("observations")), common | {c: F.col(c) for c in ("hk_type", "value", "unit")})


def document_lines(observations: DataFrame, file: str, run_id: str, person: str | None = None) -> DataFrame:
    """Lines of the observations (event_time, code, value, unit) of clinical documents."""
    common = _common("cda", F.lit(person or "unresolved"), F.lit(file), run_id)
    return keyed_lines(observations.withColumn("stream", F.lit("observations")), common | {c: F.col(c) for c in ("code", "value", "unit")})


def resource_lines(raw: DataFrame, people: DataFrame, run_id: str, person: str | None = None) -> DataFrame:
    """Lines of clinical resources, raw (file, text), of the four kinds; people (system, value, person) knows their subjects.

    A value keeps its JSON type: numbers stay numbers, and a null that a resource states is written.
    """
    reading = F.to_json(F.try_variant_get(F.try_parse_json("text"), "$.valueQuantity.value", "variant"))
    rows = resource_rows(raw, F.col("r.resourceType").alias("resource_type"), F.when(F.col("r.resourceType") == "Observation", reading).alias("reading"))
    found = resolve_person(rows.drop("value").withColumn("system", F.lit("fhir:id")).withColumnRenamed("subject", "value"), people, person)

    def listed(json: str) -> Column:
        pairs = F.transform(F.from_json(json, CODINGS), lambda c: F.struct(c["code"].alias("code"), c["system"].alias("system")))
        return F.when(F.size(pairs) > 0, F.to_json(pairs))

    common = _common("fhir", F.col("canonical_person_id"), F.col("file"), run_id)
    ready = {"code_coding": listed("code_coding_json"), "type_coding": listed("type_coding_json"), "value": F.col("reading")}
    return keyed_lines(found, common | {c: F.col(c) for c in ("resource_type", "source_id")}, {c: F.col(c) for c in ("unit", "status")}, ready)


def _put_by(lines: DataFrame) -> str:
    """The folder to which lines are written without repeats, as their pieces, since hashes don't compress.

    Tasks of a few small files each would shuffle a row or two to each partition, which doesn't compress either, so there are no
    more of them than partitions.
    """
    folder, tasks = new_folder(lines.sparkSession, "lines"), int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.select("stream", *GIVEN_KEYS, *PIECES).coalesce(tasks).distinct().write.option("compression", "zstd").parquet(folder)
    return folder


def export(lines: DataFrame | Iterable[DataFrame], path: str, compression: str = "none") -> None:
    """Write the lines of keyed_lines() below path, a folder stream=... for each stream, part after part in the order of
    the six keys, NULL as empty; of equal event keys one line stays.

    Lines of several sources, which share no line, may come one after another: each source is read and put by before the
    next is asked for, so what it was read from can go then. One job writes all streams: rows are cut into ranges of stream
    and keys, and only pieces are shuffled, without event keys. Medications and conditions without rows have no folder,
    observations and documents an empty one.
    """
    folders = []
    for source in [lines] if isinstance(lines, DataFrame) else lines:
        spark = source.sparkSession
        folders.append(_put_by(source))
    parts = spark.read.schema(", ".join(f"{c} string" for c in ("stream", *GIVEN_KEYS, *PIECES))).parquet(*folders)
    order = lambda key: ["stream", *[F.coalesce(k, F.lit("")) for k in GIVEN_KEYS], key]
    dealt = parts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order(_event_key()))
    dealt.withColumn("event_key", _event_key()).sortWithinPartitions(*order("event_key")).select("stream", _line().alias("value")).write.partitionBy("stream").option("compression", compression).text(path)
    for stream in ALWAYS:
        if not exists(spark, f"{path}/stream={stream}"):
            parts.where("false").select(F.lit("").alias("value")).write.text(f"{path}/stream={stream}")
    for folder in folders:
        drop_folder(spark, folder)
