"""Column expressions of the engine: times, names, keys, codings, labels. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 8601 as the tables accept it: calendar dates, optional time, optional fraction and zone.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?([+-]\d{2}:?\d{2}|Z)?)?$"
#: Numbers as text.
NUMBER = r"(?i)^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(nan|inf|infinity))\s*$"
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def format_time(ts: Column) -> Column:
    """A timestamp (session zone UTC) as text in whole seconds."""
    return F.date_format(ts, STAMP)


def parse_time(text: Column) -> Column:
    """ISO text to a timestamp in whole seconds; anything else is NULL."""
    return F.date_trunc("second", F.when(text.rlike(ISO_TIME), F.try_to_timestamp(text)))


def normalize_time(text: Column) -> Column:
    """Three formats to UTC text: `2020-01-01 00:00:00 -0500`, `20200101000000` and ISO; other text as it is, without the blanks
    around it; NULL if nothing is left."""

    def of(t: Column) -> Column:
        found = F.coalesce(
            F.when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss Z"))),
            F.when(t.rlike(r"^\d{14}$"), F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss"))),
            parse_time(t),
        )
        return F.when(t != "", F.coalesce(format_time(found), t))

    # As the one element of an array the text is worked out once, however often the formats look at it.
    return F.transform(F.array(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), of)[0]


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_text(*columns: Column) -> Column:
    """The first that is neither NULL nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def redact_path(path: Column) -> Column:
    """An absolute path becomes its last part."""
    return F.when(path.startswith("/"), F.element_at(F.split(path, "/"), -1)).otherwise(path)


def subject_id(reference: Column) -> Column:
    return blank_to_null(F.regexp_extract(reference, "^Patient/(.*)$", 1))


def number(text: Column) -> Column:
    """Text to double where it is a number; JSON's true and false count as 1 and 0."""
    plain = F.regexp_replace(F.lower(F.trim(text)), r"^([+-]?)inf(inity)?$", "$1Infinity")
    return F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)).when(text.rlike(NUMBER), plain.try_cast("double"))


def content_key(*columns: Column) -> Column:
    """SHA-256 of the payload as compact JSON; give the columns in name order. NULL members are part of it."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def stable_json(text: Column) -> Column:
    """A JSON value as compact text with sorted keys; text that is no JSON, and NULL, stay as they are."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def fallback_keys(record_key: Column, event_key: Column, line: Column) -> tuple[Column, Column]:
    """(record_key, event_key): the record key falls back to the event key, then to the hash of the line; the event key to that."""
    record = F.coalesce(blank_to_null(record_key), blank_to_null(event_key), F.sha2(line.cast("binary"), 256))
    return record, F.coalesce(blank_to_null(event_key), record)


def name_parts(name: Column) -> Column:
    """struct(first, last) of `First ... Last` or `Last, First ...`; NULL unless both are there."""
    squeezed = F.trim(F.regexp_replace(name, r"\s+", " "))
    comma = F.contains(squeezed, F.lit(","))
    before, after = F.trim(F.substring_index(squeezed, ",", 1)), F.trim(F.regexp_extract(squeezed, "^[^,]*,(.*)$", 1))
    words = F.split(squeezed, " ")
    first = F.when(comma, F.substring_index(after, " ", 1)).otherwise(words[0])
    last = F.when(comma, before).when(F.size(words) > 1, F.element_at(words, -1)).otherwise(F.lit(""))
    return F.when((first != "") & (last != ""), F.struct(first.alias("first"), last.alias("last")))


def fold_name(name: Column) -> Column:
    """Trimmed, white space collapsed, case folded (ss for sharp s)."""
    return F.replace(F.lower(F.regexp_replace(F.trim(name), r"\s+", " ")), F.lit("ß"), F.lit("ss"))


CODINGS = "array<struct<system:string,code:string>>"


def codings(json: Column) -> Column:
    """JSON text of a coding list to the sorted pairs whose system and code are not blank."""
    listed = F.filter(F.from_json(json, CODINGS), lambda c: (F.trim(c["system"]) != "") & (F.trim(c["code"]) != ""))
    return F.array_sort(F.coalesce(listed, F.array().cast(CODINGS)))


def external_ids(resource_id: Column, identifiers: Column) -> Column:
    """The resource's own id under `fhir:id`, then its identifiers, without blanks and repeats, in order."""
    own = F.array(F.struct(F.lit("fhir:id").alias("system"), resource_id.alias("value")))
    every = F.concat(own, F.coalesce(F.from_json(identifiers, "array<struct<system:string,value:string>>"), F.array().cast("array<struct<system:string,value:string>>")))
    return F.array_distinct(F.filter(every, lambda x: (F.trim(x["system"]) != "") & (F.trim(x["value"]) != "")))


def sha(*columns: Column) -> Column:
    return F.sha2(F.concat_ws(":", *columns).cast("binary"), 256)


def source_bucket(source: Column, source_file: Column) -> Column:
    return F.when(source_file.like("ndjson/%"), "ios").otherwise(source)


def record_type(stream: Column) -> Column:
    """The label of a row: type of device record, resource type or code, whichever its stream has first."""
    rt, code, hk = F.col("resource_type"), F.col("code"), F.col("hk_type")
    unknown = F.lit("unknown")
    return (
        F.when(stream == "observations", F.coalesce(hk, rt, code, unknown))
        .when(stream == "conditions", F.coalesce(rt, code, unknown))
        .otherwise(F.coalesce(rt, unknown))
    )


def resource_time(kind: Column, text: Column) -> Column:
    """Event time of a clinical resource from its JSON text, by kind."""
    at = lambda *paths: first_text(*[F.get_json_object(text, p) for p in paths])
    return time_of_kind(kind, at)


def time_of_kind(kind: Column, at) -> Column:
    """Event time by kind; at(paths) is the first text that a resource has under them."""
    found = (
        F.when(kind == "Observation", at("$.effectiveDateTime", "$.effectivePeriod.start", "$.issued"))
        .when(kind == "DocumentReference", at("$.date", "$.indexed"))
        .when(kind == "MedicationRequest", at("$.authoredOn"))
        .when(kind == "Condition", at("$.recordedDate", "$.onsetDateTime"))
    )
    return normalize_time(found)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
