"""De-identification: names of known people in texts, JSON and clinical documents."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .names import Names, forms
from .skew import spread_join

#: People that are sent to every task (some 100 MB there); where more are known, a text's own people come to it by joins.
MOST_NAMES = 200_000


def name_redactor(people: list[tuple[str, str, str]]) -> Callable[[str], str]:
    """people: (first, last, label) in label order."""
    return Names((no, *person) for no, person in enumerate(people)).redact


def redact_values(value, redact: Callable[[str], str]):
    """Every string value at any depth; keys stay."""
    if isinstance(value, str):
        return redact(value)
    if isinstance(value, list):
        return [redact_values(v, redact) for v in value]
    if isinstance(value, dict):
        return {k: redact_values(v, redact) for k, v in value.items()}
    return value


def redact_json(text: str, redact: Callable[[str], str]) -> str:
    """JSON by its values, text that is no JSON as plain text."""
    try:
        value = json.loads(text)
    except ValueError:
        return redact(text)
    return json.dumps(redact_values(value, redact), ensure_ascii=False, separators=(",", ":"))


def redact_patient(text: str, label: str) -> str:
    """A Patient resource with the label in the forms of each of its names and a neutral birth date; other resources stay."""
    if "Patient" not in text and "\\" not in text:
        return text
    try:
        value = json.loads(text)
    except ValueError:
        return text
    if not isinstance(value, dict) or value.get("resourceType") != "Patient":
        return text
    names = value.get("name")
    for name in names if isinstance(names, list) else []:
        if isinstance(name, dict):
            name |= {"text": label, "given": ["Patient"], "family": label.partition(" ")[2]}
    value |= {"birthDate": "1900-01-01"} if "birthDate" in value else {}
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def redact_cda(text: str, label: str) -> str:
    """A clinical document whose patients have the label as their names and a neutral birth time. Text that is no XML stays.

    Of each patientRole the patient's own name elements are replaced, not those of organisations beside it.
    """
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return text
    local = lambda e: e.tag.rpartition("}")[2]
    for role in (e for e in root.iter() if local(e) == "patientRole"):
        patient = next((e for e in role if local(e) == "patient"), None)
        for e in patient if patient is not None else ():
            if local(e) == "name":
                e.clear()
                e.text = label
        for e in patient.iter() if patient is not None else ():
            if local(e) == "birthTime":
                e.set("value", "19000101")
    return ET.tostring(root, encoding="unicode")


def _mapped(df: DataFrame, column: str, change: Callable[..., Callable[..., str]], *with_columns: str) -> DataFrame:
    """df with column changed text by text; change() is called once a task and gives the function of (text, *with_columns)."""
    names = df.columns
    at, more = names.index(column), [names.index(c) for c in with_columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = change()
        for batch in batches:
            given = [batch.column(i).to_pylist() for i in (at, *more)]
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else f(t, *rest) for t, *rest in zip(*given)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, df.schema)


def redact_names(df: DataFrame, column: str, people: DataFrame, as_json: bool = False) -> DataFrame:
    """df with the names of people (first, last, label) in column replaced by their labels, in label order.

    `First Last` and `Last, First` are replaced, whatever the case and the white space; where names overlap the earlier label
    wins, and what a label adds can be part of a later name. Of people of one name the earliest label counts. Up to MOST_NAMES
    people are sent to every task, and the texts are read once, without a shuffle; more are met by joins.
    """
    number = F.regexp_extract("label", r"(\d+)$", 1).cast("long")
    rows = people.select(number.alias("no"), "first", "last", "label")
    if rows.count() > MOST_NAMES:
        return _redacted_by_joins(df, column, rows, as_json)
    known = df.sparkSession.sparkContext.broadcast([tuple(r) for r in rows.collect()])

    def change():
        redact = Names(known.value).redact
        return (lambda t: redact_json(t, redact)) if as_json else redact

    return _mapped(df, column, change)


def _strings(text: str, as_json: bool) -> list[str]:
    """The texts in which names are looked for: the string values of JSON, else text itself."""
    found: list[str] = []
    redact_json(text, lambda t: found.append(t) or t) if as_json else found.append(text)
    return found


def _redacted_by_joins(df: DataFrame, column: str, people: DataFrame, as_json: bool) -> DataFrame:
    """redact_names() for any number of people: runs of words of the texts meet the names that they spell by their hashes.

    What labels add makes new runs, which are looked up in a further round; usually none of them is a name and the second round
    is the last. A text's own people are at most as many as its runs.
    """
    key, row = "name_key", "name_row"
    hashed = F.xxhash64(key).alias(key)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(" ".join(words), len(words), f"{first.lower()}\0{last.lower()}", no, first, last, label) for no, first, last, label in zip(*(c.to_pylist() for c in batch.columns)) for words in forms(first, last) if words]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], [key, "n", "same", "no", "first", "last", "label"])

    names = people.mapInArrow(spelled, f"{key} string, n int, same string, no long, first string, last string, label string")
    person = F.struct("no", "first", "last", "label")
    names = names.select(hashed, "n", "same", "no", person.alias("person")).groupBy(key, "same").agg(F.min_by("person", "no").alias("person"), F.min("n").alias("n"))
    names = written(names)
    lengths = sorted(r.n for r in names.select("n").distinct().collect())
    names = names.groupBy(key).agg(F.collect_list("person").alias("people"))
    df = written(df.withColumn(row, F.monotonically_increasing_id()))  # the numbers hold whatever the order in which df's rows come
    rows = df.select(row, F.col(column).alias("name_text")).where("name_text is not null")
    no_people = F.array().cast("array<struct<no:bigint,first:string,last:string,label:string>>")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = Names([], lengths)
        for batch in batches:
            found = [(i, " ".join(run)) for i, text in zip(*(c.to_pylist() for c in batch.columns)) for run in {r for t in _strings(text, as_json) for r in every.runs(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], [row, key])

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, made = [], []
            for text, own in zip(batch.column(1), batch.column(2).to_pylist()):
                names = Names([(p["no"], p["first"], p["last"], p["label"]) for p in own], lengths)
                texts.append(redact_json(text.as_py(), names.redact) if as_json else names.redact(text.as_py()))
                made.append([" ".join(r) for r in names.made])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(made, pa.list_(pa.string()))], [row, "name_new", "made"])

    runs = rows.mapInArrow(asked, f"{row} long, {key} string").select(row, hashed)
    met = None
    while True:
        runs = written(runs)
        hits = spread_join(runs, names, [key], F.col(row), runs.count()).select(row, F.explode("people").alias("person"))
        new = hits if met is None else hits.join(met, [row, "person"], "left_anti")
        new = written(new.distinct())
        if met is not None and new.isEmpty():
            break
        met = new if met is None else written(met.unionByName(new))
        own = met.groupBy(row).agg(F.collect_list("person").alias("own"))
        done = written(rows.join(own, row, "left").select(row, "name_text", F.coalesce("own", no_people).alias("own")).mapInArrow(redacted, f"{row} long, name_new string, made array<string>"))
        runs = done.select(row, F.explode("made").alias(key)).select(row, hashed)
    numbered = df.join(done.select(row, "name_new"), row, "left")
    return numbered.select(*[F.col("name_new").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns if c != row])


def redact_patients(df: DataFrame, column: str, label: str, people: DataFrame | None = None) -> DataFrame:
    """df with the Patient resources in column under the label of the column label; first, the names of people go from all
    string values."""
    return _mapped(df if people is None else redact_names(df, column, people, as_json=True), column, lambda: redact_patient, label)


def redact_cdas(df: DataFrame, column: str, label: str, people: DataFrame | None = None) -> DataFrame:
    """df with the patients of the clinical documents in column under the label of the column label; then, the names of people
    go from the whole text."""
    out = _mapped(df, column, lambda: redact_cda, label)
    return out if people is None else redact_names(out, column, people)
