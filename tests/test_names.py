"""Names in texts: equal to replacing one person after the other, and linear in the text."""

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from vitalstream.operators import privacy
from vitalstream.operators.names import Names


def one_by_one(people, text):
    """The rule itself: each person in turn, both forms, by regular expressions over the whole text."""
    seen = set()
    for _, first, last, label in sorted(people):
        if (first.lower(), last.lower()) in seen:
            continue
        seen.add((first.lower(), last.lower()))
        a, b = re.escape(first), re.escape(last)
        for pattern in (rf"\b{a}\s+{b}\b", rf"\b{b}\s*,\s*{a}\b"):
            text = re.sub(pattern, lambda m: label, text, flags=re.I)
    return text


NAMES = st.sampled_from(["ann", "Lee", "bo", "patient", "2", "Ann-Lee", "O'Neil", "x", "von Bo", "Éva", "lee."])
PARTS = st.sampled_from(["ann", "LEE", "Bo", "patient", "2", "von", "O", "Neil", "x", "éva", " ", "  ", "\n", ",", ", ", "-", "'", ".", " and "])


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.tuples(NAMES, NAMES), max_size=6), st.lists(PARTS, max_size=16))
def test_equals_one_by_one(names, parts):
    people = [(i, a, b, f"Patient {i}") for i, (a, b) in enumerate(names, 1)]
    text = "".join(parts)
    assert Names(people).redact(text) == one_by_one(people, text)


def test_label_order_and_labels_in_names():
    people = [(1, "Ann", "Lee", "Patient 1"), (2, "Lee", "Ann", "Patient 2"), (3, "Patient", "2", "Patient 3"), (4, "x", "Patient", "Patient 4")]
    assert Names(people).redact("Ann Lee Ann, ann  lee; Lee,Ann") == "Patient 1 Ann, Patient 1; Patient 1"
    assert Names(people).redact("x Lee Ann") == one_by_one(people, "x Lee Ann") == "Patient 4 3"


def test_a_text_of_many_names_is_linear():
    people = [(i, f"first{i}", f"last{i}", f"Patient {i}") for i in range(20000)]
    start = time.process_time()
    names = Names(people)
    assert time.process_time() - start < 2
    took = []
    for n in (4000, 16000):
        text = ". ".join(f"Saw First{i} LAST{i} and last{i}, first{i}" for i in range(n))
        start = time.process_time()
        got = names.redact(text)
        took.append(time.process_time() - start)
        assert got == ". ".join(f"Saw Patient {i} and Patient {i}" for i in range(n))
    assert took[0] < 1.5 and took[1] < 8 * took[0]
    start = time.process_time()
    assert names.redact("first1 last1 " * 40000) == "Patient 1 " * 40000
    assert time.process_time() - start < 6


def test_people_by_join(spark, monkeypatch):
    """More people than are sent to every task: those of a text come by joins, also where a label makes a name."""
    people = [(i, f"first{i % 40}", f"last{i}", f"Patient {i}") for i in range(1, 120)] + [(500, "x", "Patient", "Patient 500"), (501, "9", "Lee", "Patient 501"), (502, "Patient", "501", "Patient 502"), (503, "first1", "last1", "Patient 503")]
    texts = [f"Saw First{i % 40} last{i} and LAST{i}, first{i % 40}; x first3 last3, last49, first9 lee" for i in range(60)] + [None, "", "x", "first1 last1 " * 500, "first1 last1 " * 500]
    df = spark.createDataFrame([(i % 50, t, 1) for i, t in enumerate(texts)], "id int, text string, row int")
    known = spark.createDataFrame([p[1:] for p in people], "first string, last string, label string")
    wanted = sorted((i % 50, t and one_by_one(people, t), 1) for i, t in enumerate(texts) if t is not None)
    found = []
    for limit in (privacy.MOST_NAMES, 0):
        monkeypatch.setattr(privacy, "MOST_NAMES", limit)
        rows = [tuple(r) for r in privacy.redact_names(df, "text", known).collect()]
        assert len(rows) == len(texts)
        found.append(sorted(r for r in rows if r[1] is not None))
    assert found[0] == wanted and found[1] == wanted
    monkeypatch.setattr(privacy, "MOST_NAMES", 0)
    as_json = spark.createDataFrame([('{"first1 last1":"first1 last1","a":["x first2 last2"]}',), ("no json first1 last1",)], "text string")
    got = {r.text for r in privacy.redact_names(as_json, "text", known, as_json=True).collect()}
    assert got == {'{"first1 last1":"Patient 1","a":["Patient 500 2"]}', "no json Patient 1"}
