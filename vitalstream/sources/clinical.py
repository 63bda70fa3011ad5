"""Clinical resources as JSON text: reading them, and deriving them from the driver's tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import CODINGS, blank_to_null, codings, external_ids, first_text, subject_id, time_of_kind
from .tables import spread, table

#: event_id % 7 gives the kind; the two broken ones are cut JSON and an array.
_TIME = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
_SUBJECT = "concat('\"subject\":{\"reference\":\"Patient/u', user_id, '\"}')"
_CODES = "concat('[{\"system\":\"s2\",\"code\":\"', event_type, '\"},{\"system\":\" \",\"code\":\"x\"},{\"system\":\"s1\",\"code\":\"c', event_id % 5, '\"}]')"
RESOURCE = f"""CASE event_id % 7
WHEN 0 THEN concat('{{"resourceType":"Observation","id":"r', event_id, '","status":"final",', {_SUBJECT}, ',"effectiveDateTime":"', {_TIME}, '","code":{{"coding":', {_CODES}, '}},"valueQuantity":{{"value":', event_id % 100, ',"unit":"bpm"}}}}')
WHEN 1 THEN concat('{{"resourceType":"Observation","id":"r', event_id, '",', {_SUBJECT}, ',"effectiveDateTime":"","effectivePeriod":{{"start":"', {_TIME}, '"}},"code":{{"coding":', {_CODES}, '}}}}')
WHEN 2 THEN concat('{{"resourceType":"DocumentReference","id":"r', event_id, '","status":"current",', {_SUBJECT}, ',"indexed":"', {_TIME}, '","type":{{"coding":', {_CODES}, '}}}}')
WHEN 3 THEN concat('{{"resourceType":"MedicationRequest","id":"r', event_id, '","status":"active",', {_SUBJECT}, ',"authoredOn":"', {_TIME}, '"}}')
WHEN 4 THEN concat('{{"resourceType":"Condition","id":"r', event_id, '",', {_SUBJECT}, ',"onsetDateTime":"', {_TIME}, '","code":{{"coding":', {_CODES}, '}}}}')
WHEN 5 THEN concat('{{"resourceType":"Patient","id":"u', user_id, '","birthDate":"1980-01-02","name":[{{"given":["Ann', user_id % 40, '","Q"],"family":"Lee', user_id % 7, '"}}],"identifier":[{{"system":"mrn","value":"m', user_id % 60, '"}},{{"system":"","value":"x"}}]}}')
ELSE CASE WHEN event_id % 2 = 0 THEN concat('{{"resourceType":"Observ', event_id) ELSE concat('[', event_id, ']') END END"""


def raw_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): one resource text per event, dealt over tasks while the rows are short."""
    return spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), "event_id").select("event_id", F.concat(F.lit("clinical-records/"), F.col("event_id").cast("string"), F.lit(".json")).alias("file"), F.expr(RESOURCE).alias("text"))


def valid_resources(raw: DataFrame) -> DataFrame:
    """(file, text, kind): the texts that are JSON objects; others are skipped. Further columns stay."""
    parsed = F.try_parse_json("text")
    return raw.where(parsed.isNotNull() & F.schema_of_variant(parsed).like("OBJECT%")).withColumn("kind", F.get_json_object("text", "$.resourceType"))


def field(path: str) -> Column:
    return F.get_json_object("text", path)


#: What is read of a resource, as text; a number keeps its digits only in the text itself, so values are not here.
FIELDS = (
    "resourceType string, id string, status string, subject struct<reference:string>, effectiveDateTime string, effectivePeriod struct<start:string>, issued string, "
    "date string, indexed string, authoredOn string, recordedDate string, onsetDateTime string, code struct<coding:string>, type struct<coding:string>"
)


def resource_rows(raw: DataFrame, *more: Column) -> DataFrame:
    """Canonical columns of every resource of the four kinds; patients and other kinds give no row. A resource without an id
    has no source_id. more are further columns, of text or of the fields in r.

    A text is parsed once to see that it is JSON and once for its fields. These come out of a generator, so that the plan does
    not parse anew for each of them.
    """
    parsed = F.try_parse_json("text")
    rows = raw.where(parsed.isNotNull() & F.schema_of_variant(parsed).like("OBJECT%")).select("file", "text", F.explode(F.array(F.from_json("text", FIELDS))).alias("r"))
    kind = F.col("r.resourceType")
    rows = rows.where(kind.isin("Observation", "DocumentReference", "MedicationRequest", "Condition"))
    stream = F.when(kind == "Observation", "observations").when(kind == "DocumentReference", "documents").when(kind == "MedicationRequest", "medications").otherwise("conditions")
    coded = kind.isin("Observation", "Condition")
    at = lambda *paths: first_text(*[F.col(f"r{p[1:]}") for p in paths])
    listed = lambda c: F.to_json(codings(F.coalesce(c, F.lit("[]"))))
    return rows.select(
        "file",
        stream.alias("stream"),
        F.concat(kind, F.lit("/"), blank_to_null(F.col("r.id"))).alias("source_id"),
        subject_id(F.col("r.subject.reference")).alias("subject"),
        time_of_kind(kind, at).alias("event_time"),
        F.when(coded, listed(F.col("r.code.coding"))).alias("code_coding_json"),
        F.when(kind == "DocumentReference", listed(F.col("r.type.coding"))).alias("type_coding_json"),
        F.when(kind == "Observation", field("$.valueQuantity.value")).alias("value"),
        F.when(kind == "Observation", field("$.valueQuantity.unit")).alias("unit"),
        F.when(kind != "Condition", F.col("r.status")).alias("status"),
        *more,
    )


def patient_name(text: str = "text") -> Column:
    """name[0].text, else the first given name and the family, else the narrative."""
    at = lambda p: F.get_json_object(text, p)
    pair = F.when(first_text(at("$.name[0].given[0]")).isNotNull() & first_text(at("$.name[0].family")).isNotNull(), F.concat_ws(" ", at("$.name[0].given[0]"), at("$.name[0].family")))
    return F.coalesce(first_text(at("$.name[0].text")), pair, first_text(at("$.text.div")))


def patient_ids(text: str = "text") -> Column:
    return external_ids(F.get_json_object(text, "$.id"), F.get_json_object(text, "$.identifier"))


#: A mark, a string, or a number or word of JSON, behind white space; the words are those that Python's own reader takes.
_TOKEN = re.compile(
    r'[ \t\n\r]*+(?:([][{},:])|("[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})[^"\\\x00-\x1f]*+)*+")'
    r"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null|NaN|-?Infinity)"
)
_VALUE = "{[sv"


def _unquoted(string: str) -> str:
    """The characters of a JSON string; halves of surrogate pairs become ?."""
    return string[1:-1] if "\\" not in string else json.loads(string).encode("utf-8", "replace").decode()


class _Open:
    """An object or array that is being read: where it starts, the key or index it is at, and where the finds of each key lie."""

    __slots__ = ("at", "begun", "is_object", "kind", "seen", "slot", "start")

    def __init__(self, is_object: bool, start: int, slot: int):
        self.is_object, self.start, self.slot, self.kind = is_object, start, slot, None
        self.at, self.begun, self.seen = None if is_object else 0, slot, {}

    def step(self) -> str:
        return f".{self.at}" if self.is_object else f"[{self.at:06}]"


#: Deeper documents are read by their tokens.
MOST_LEVELS = 100


class _AsWritten(Exception):
    """A document whose objects can only be given as written by its tokens."""


def _whole_number(text: str) -> int:
    if len(text) > 300 or text == "-0":
        raise _AsWritten
    return int(text)


def _fraction(text: str) -> float:
    if repr(value := float(text)) != text:
        raise _AsWritten
    return value


def _once(pairs: list[tuple]) -> dict:
    value = dict(pairs)
    if len(value) != len(pairs):
        raise _AsWritten
    return value


def _word(text: str):
    raise _AsWritten


_DECODER = json.JSONDecoder(object_pairs_hook=_once, parse_int=_whole_number, parse_float=_fraction, parse_constant=_word)
_compact = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), check_circular=False).encode


def nested(text: str, kinds: frozenset[str] | None = None) -> Iterator[tuple[str, str, str]]:
    """_nested() by Python's own reader, where that gives every object back as written: no escapes, no key twice in an object,
    numbers in their usual form. Else, and for what is no JSON or too deep for it, by the tokens."""
    if "\\" in text:
        return _nested(text, kinds)
    try:
        value = _DECODER.decode(text)
        found, waiting = [], [("$", value, 0)]
        while waiting:
            path, here, depth = waiting.pop()
            if depth > MOST_LEVELS:
                raise _AsWritten
            if type(here) is dict:
                kind = here.get("resourceType")
                if type(kind) is str and (kinds is None or kind in kinds):
                    found.append((path, kind, here))
                inner = [(f"{path}.{k}", v, depth + 1) for k, v in here.items() if type(v) is dict or type(v) is list]
            elif type(here) is list:
                inner = [(f"{path}[{i:06}]", v, depth + 1) for i, v in enumerate(here) if type(v) is dict or type(v) is list]
            else:
                break
            waiting += inner[::-1]
    except (_AsWritten, ValueError, RecursionError):
        return _nested(text, kinds)
    return ((path, kind, _compact(here)) for path, kind, here in found)


def _nested(text: str, kinds: frozenset[str] | None = None) -> Iterator[tuple[str, str, str]]:
    """(path, kind, text) of every object of a JSON text that has a resourceType, in document order; ValueError if it is no JSON.

    The tokens are read once with a stack of open objects, so depth has no limit, and an object's text is a piece of the
    document without its white space: numbers and strings stay as written. Of a repeated key the last value counts.
    """
    out, size, end = [], 0, 0
    stack: list[_Open] = []
    found: list[tuple[str, str, int, int] | None] = []
    allowed = _VALUE
    while True:
        token = _TOKEN.match(text, end)
        if token is None:
            raise ValueError(f"no JSON at {end}")
        end = token.end()
        mark, string = token.groups()
        sign = mark or ("s" if string else "v")
        if sign not in allowed:
            raise ValueError(f"no JSON at {end}")
        piece = mark or string or token[0].lstrip(" \t\n\r")
        out.append(piece)
        size += len(piece)
        top = stack[-1] if stack else None
        if sign == "{" or sign == "[":
            stack.append(_Open(sign == "{", size - 1, len(found)))
            found.append(None)
            allowed = "s}" if sign == "{" else _VALUE + "]"
            continue
        if sign == ":":
            allowed = _VALUE
            continue
        if sign == ",":
            if top.is_object:
                top.at, allowed = None, "s"
            else:
                top.at, allowed = top.at + 1, _VALUE
            continue
        if sign == "s" and top is not None and top.is_object and top.at is None:
            top.at = _unquoted(string)
            for i in range(*top.seen.get(top.at, (0, 0))):
                found[i] = None
            top.begun, allowed = len(found), ":"
            continue
        value = None
        if sign == "}" or sign == "]":
            stack.pop()
            if top.kind is not None and (kinds is None or top.kind in kinds):
                found[top.slot] = ("$" + "".join(o.step() for o in stack), top.kind, top.start, size)
        elif sign == "s":
            value = string
        if not stack:
            break
        top = stack[-1]
        if top.is_object:
            top.seen[top.at] = (top.begun, len(found))
            if top.at == "resourceType":
                top.kind = None if value is None else _unquoted(value)
        allowed = ",}" if top.is_object else ",]"
    if text[end:].strip(" \t\n\r"):
        raise ValueError(f"no JSON at {end}")
    whole = "".join(out)
    return ((path, kind, whole[a:b]) for path, kind, a, b in filter(None, found))


def walk(raw: DataFrame, kinds: tuple[str, ...] | None = None, batch_chars: int = 16 << 20) -> DataFrame:
    """(file, path, kind, text): every nested object that has a resourceType (of kinds, if given), whatever its depth, of raw
    (file, text).

    A document is walked in its task, in one pass (nested()); array positions in the path are zero-padded, so paths sort in document
    order within arrays. Text that is no JSON gives no row. Rows go out batch_chars at a time, as each object's text holds
    those of the objects in it.
    """
    wanted = None if kinds is None else frozenset(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 4)], ["file", "path", "kind", "text"])

        for batch in batches:
            for file, text in zip(*batch.columns):
                try:
                    found = nested(text.as_py() or "", wanted)
                except ValueError:
                    continue
                for path, kind, piece in found:
                    rows.append((file.as_py(), path, kind, piece))
                    size += len(path) + len(piece)
                    if size > batch_chars:
                        yield batch_of()
                        rows, size = [], 0
        yield batch_of()

    return raw.select("file", "text").mapInArrow(run, "file string, path string, kind string, text string")


def resource_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): one row per clinical JSON file below path, whatever its lines; file is the path below the folder.

    A file is one resource (or one bundle) and is read whole, as the format asks for; many files are read side by side.
    """
    name = F.regexp_replace(F.col("_metadata.file_path"), r"^.*?" + re.escape(path.rstrip("/").split(":")[-1]) + "/", "")
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(name.alias("file"), F.col("value").alias("text"))


__all__ = ["CODINGS", "field", "patient_ids", "patient_name", "raw_resources", "resource_files", "resource_rows", "valid_resources", "walk"]
