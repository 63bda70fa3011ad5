"""The walk over nested resources, against Python's own JSON reader."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitalstream.sources import clinical

SCHEMA = "file string, text string"
KEYS = st.sampled_from(["resourceType", "a", "b", "\u00e9", 'q"', "\n", ""])
LEAVES = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=True) | st.text(max_size=5) | st.sampled_from(["Patient", "Bundle"])
VALUES = st.recursive(LEAVES, lambda inner: st.lists(inner, max_size=3) | st.dictionaries(KEYS, inner, max_size=4), max_leaves=25)


def plainly(value, path="$"):
    """(path, kind, value) of every object with a resourceType, by recursion over what json.loads gives."""
    if isinstance(value, dict):
        if isinstance(value.get("resourceType"), str):
            yield path, value["resourceType"], value
        for key, x in value.items():
            yield from plainly(x, f"{path}.{key}")
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from plainly(x, f"{path}[{i:06}]")


@settings(max_examples=300, deadline=None)
@given(VALUES, st.sampled_from([None, 1]), st.booleans())
def test_equal_to_a_recursive_walk(value, indent, ascii_only):
    text = json.dumps(value, indent=indent, ensure_ascii=ascii_only)
    got = [(path, kind, json.dumps(json.loads(piece))) for path, kind, piece in clinical._nested(text)]
    assert got == [(path, kind, json.dumps(x)) for path, kind, x in plainly(value)]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='{}[],:"\\\\ue0159.-+ \n\ttrufalsNIinity', max_size=14) | VALUES.map(json.dumps).flatmap(lambda t: st.integers(0, len(t)).map(lambda i: t[:i] + t[i + 1 :])))
def test_takes_what_is_json(text):
    try:
        json.loads(text)
        taken = True
    except ValueError:
        taken = False
    try:
        list(clinical._nested(text))
        assert taken
    except ValueError:
        assert not taken


def test_text_stays_as_written(spark):
    rows = [
        ("digits", ' { "resourceType" : "Observation",\n "valueQuantity": {"value": 1.10, "far": 12345678901234567890.10e+2} } '),
        ("twice", '{"a":{"resourceType":"Gone"},"resourceType":"Old","a":{"resourceType":"Kept"},"resourceType":"New"}'),
        ("escaped", '{"r\\u0065sourceType":"A\\u00e9","\\ud800":{"resourceType":"B"}}'),
        ("cut", '{"resourceType":"A"'),
        ("more", '{"resourceType":"A"} 1'),
        ("empty", ""),
        (None, '{"resourceType":"Anon"}'),
    ]
    got = {(r.file, r.path): (r.kind, r.text) for r in clinical.walk(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[("digits", "$")] == ("Observation", '{"resourceType":"Observation","valueQuantity":{"value":1.10,"far":12345678901234567890.10e+2}}')
    assert {k: v[0] for k, v in got.items() if k[0] == "twice"} == {("twice", "$"): "New", ("twice", "$.a"): "Kept"}
    assert {k: v[0] for k, v in got.items() if k[0] == "escaped"} == {("escaped", "$"): "A\u00e9", ("escaped", "$.?"): "B"}
    assert (None, "$") in got and {f for f, _ in got} == {"digits", "twice", "escaped", None}
    assert clinical.walk(spark.createDataFrame([], SCHEMA)).collect() == []


def test_five_thousand_levels(spark):
    """All objects of a document of 5,000 levels, in batches; a patient at its bottom alone; brackets without end give no row."""
    deep = '{"resourceType":"B","r":' * 5000 + '{"resourceType":"Patient","id":"9","v":1.10}' + "}" * 5000
    frame = spark.createDataFrame([("deep", deep), ("open", "[" * 200_000)], SCHEMA)
    row = clinical.walk(frame).agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"), F.max(F.length("text")).alias("longest"), F.max(F.length("path")).alias("path")).first()
    assert (row.n, row.paths, row.longest, row.path) == (5001, 5001, len(deep), 10_001)
    bottom = clinical.walk(frame, ("Patient",)).collect()
    assert [(r.kind, r.text) for r in bottom] == [("Patient", '{"resourceType":"Patient","id":"9","v":1.10}')]


PLAIN = '{"resourceType": "Bundle", "n": -0.5, "entry": [{"resource": {"resourceType": "Patient", "id": "\u00e9", "k": 12}}, [], 1]}'


@settings(max_examples=300, deadline=None)
@given(VALUES, st.sampled_from([None, 1]), st.booleans())
def test_python_s_reader_and_the_tokens_agree(value, indent, ascii_only):
    text = json.dumps(value, indent=indent, ensure_ascii=ascii_only)
    assert list(clinical.nested(text)) == list(clinical._nested(text))
    assert list(clinical.nested(text, frozenset(["Patient"]))) == list(clinical._nested(text, frozenset(["Patient"])))


@pytest.mark.parametrize("number", ["1.10", "-0", "-0.0", "1E5", "1e999", "9" * 400, "12", "0.1", "1e+20", "NaN"])
def test_numbers_as_written(number):
    text = f'{{"resourceType":"A","v":[{number}]}}'
    assert list(clinical.nested(text)) == [("$", "A", text)]


def test_usual_documents_need_no_tokens(monkeypatch):
    want = list(clinical._nested(PLAIN))
    monkeypatch.setattr(clinical, "_nested", lambda *_: pytest.fail("read token by token"))
    assert list(clinical.nested(PLAIN)) == want
    assert [(path, kind) for path, kind, _ in want] == [("$", "Bundle"), ("$.entry[000000].resource", "Patient")]
