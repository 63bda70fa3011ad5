import re

import pandas as pd
from pyspark.sql import functions as F

from vitalstream.functions import columns as c
from vitalstream.operators import identity, keyed, privacy, quality
from vitalstream.sources import clinical, files


def values(spark, texts, f):
    return [r.y for r in spark.createDataFrame([(t,) for t in texts], "x string").select(f(F.col("x")).alias("y")).collect()]


def test_times(spark):
    texts = ["2020-01-01 00:00:00 -0500", "20200101112233", "2020-01-01T01:02:03Z", "2020-01-01T00:00:00.9+02:00", "2020-01-01", "2020", "2020-01", "soon", "", None, " 20200101112233 ", "  ", " \t"]
    assert values(spark, texts, c.normalize_time) == ["2020-01-01T05:00:00Z", "2020-01-01T11:22:33Z", "2020-01-01T01:02:03Z", "2019-12-31T22:00:00Z", "2020-01-01T00:00:00Z", "2020", "2020-01", "soon", None, None, "2020-01-01T11:22:33Z", None, None]
    texts = texts[:10]
    parsed = values(spark, texts, lambda x: c.format_time(c.parse_time(x)))
    assert parsed == [None, None, "2020-01-01T01:02:03Z", "2019-12-31T22:00:00Z", "2020-01-01T00:00:00Z", None, None, None, None, None]


def test_names(spark):
    texts = ["John Doe", "Doe, John", "  jOhN    dOE  ", "John Q Doe", "Doe, John Q", "John", "", ", John", None]
    got = values(spark, texts, c.name_parts)
    assert [(g.first.lower(), g.last.lower()) if g else None for g in got] == [("john", "doe")] * 5 + [None] * 4
    assert values(spark, ["  Straße  X "], c.fold_name) == ["strasse x"]


def test_numbers_and_paths(spark):
    assert values(spark, ["1", " 7.5 ", "1e3", ".5", "true", "false", "12d", "1_000", "x", "", None], c.number) == [1.0, 7.5, 1000.0, 0.5, 1.0, 0.0, None, None, None, None, None]
    assert values(spark, ["inf", "-Infinity"], c.number) == [float("inf"), float("-inf")]
    assert values(spark, ["/a/b/c.xml", "a/b.xml"], c.redact_path) == ["c.xml", "a/b.xml"]
    assert values(spark, ["a/b.XML", "a.b/c", ".hidden", "x.tar.gz"], c.extension) == [".xml", "", "", ".gz"]


def test_codings_and_ids(spark):
    text = '[{"system":"s2","code":"b"},{"system":"","code":"x"},{"system":"s1","code":"c"},{"code":"only"}]'
    assert [(x.system, x.code) for x in values(spark, [text], c.codings)[0]] == [("s1", "c"), ("s2", "b")]
    assert values(spark, ["not json", None], c.codings) == [[], []]


def test_nested_observations_and_bad_documents(spark):
    xml = b'<D xmlns="u"><observation><code code="a"/><value value="1" unit="g"/><observation><code code="b"/></observation></observation></D>'
    df = spark.createDataFrame([("f", bytearray(xml)), ("g", bytearray(b"<cut")), ("h", None)], "file string, content binary")
    assert sorted((r.file, r.code, r.value) for r in files.cda_observations(df).collect()) == [("f", "a", "1"), ("f", "b", None)]


def test_resources_in_bundles(spark):
    text = '{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Patient","id":"1"}},{"resource":{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Patient","id":"2"}}]}}]}'
    got = clinical.walk(spark.createDataFrame([("f", text), ("g", "[1"), ("h", "[]")], "file string, text string")).collect()
    assert sorted((r.path, r.kind) for r in got) == [("$", "Bundle"), ("$.entry[000000].resource", "Patient"), ("$.entry[000001].resource", "Bundle"), ("$.entry[000001].resource.entry[000000].resource", "Patient")]


def test_deep_and_odd_documents(spark):
    deep = '{"x":' * 300 + '{"resourceType":"Patient","id":"9"}' + "}" * 300
    rows = [("deep", deep), ("far", "[" * 100_000), ("none", None), ("kind", '{"resourceType":5,"a":[{"resourceType":"B"}]}'), *[(f"r{i}", '{"resourceType":"A"}') for i in range(3)]]
    got = clinical.walk(spark.createDataFrame(rows, "file string, text string")).collect()
    assert sorted((r.file, r.kind) for r in got) == [("deep", "Patient"), ("kind", "B"), ("r0", "A"), ("r1", "A"), ("r2", "A")]
    assert next(r.path for r in got if r.file == "kind") == "$.a[000000]"


def test_manifest_of_large_files(spark, tmp_path, monkeypatch):
    import hashlib

    for name, data in (("small.txt", b"abc"), ("large.bin", b"xyz" * 5000)):
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(files, "ONE_CELL", 100)
    monkeypatch.setattr(files, "CHUNK", 1000)
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.sha256) for r in files.manifest(spark, str(tmp_path)).collect()}
    assert got == {"small.txt": (3, hashlib.sha256(b"abc").hexdigest()), "large.bin": (15000, hashlib.sha256(b"xyz" * 5000).hexdigest())}


def test_canonical_and_device_lines_are_in_order(spark, tmp_path):
    from vitalstream.sources import sinks

    rows = [("observations", f"k{i % 7}{i}", f"2024-01-0{1 + i % 3}T00:00:00Z" if i % 4 else None, f"p{i % 2}", "s", "f") for i in range(60)]
    ev = spark.createDataFrame(rows, "stream string, event_key string, event_time string, canonical_person_id string, source string, source_file string")
    sinks.canonical_lines(ev, f"{tmp_path}/out")
    read = lambda folder: [line for p in sorted(__import__("pathlib").Path(folder).glob("part-*")) for line in p.read_text().splitlines()]
    lines = read(f"{tmp_path}/out/observations")
    key = lambda r: (r["event_time"] or "", r["canonical_person_id"], r["source"], r["source_file"], r["event_key"])
    parsed = [__import__("json").loads(x) for x in lines]
    assert len(parsed) == 60 and parsed == sorted(parsed, key=key) and list(parsed[0]) == sorted(parsed[0])
    sinks.device_lines(ev.select(F.col("event_key").alias("record_key"), "source"), f"{tmp_path}/device")
    keys = [__import__("json").loads(x)["record_key"] for x in read(f"{tmp_path}/device")]
    assert len(keys) == 60 and keys == sorted(keys)


def test_default_person_and_planned_runs(spark):
    people = lambda *names: spark.createDataFrame([(n,) for n in names], "person string")
    assert keyed.default_person(people("a", "a", None)) == "a"
    assert keyed.default_person(people("a", "b")) is None and keyed.default_person(people()) is None
    runs = spark.createDataFrame([("r1", "x", 1), ("r2", "y", 2)], "run_id string, sha256 string, created int")
    inputs = spark.createDataFrame([("i1", "y", None, None), ("i2", "x", "r1", "r1"), ("i3", "x", None, "r1"), ("i4", "z", "gone", None)], "input_id string, sha256 string, since string, expected_run_id string")
    got = {r.input_id: (r.parent_run_id, r.state) for r in keyed.plan_runs(runs, inputs, "created").collect()}
    assert got == {"i1": ("r2", "no_change"), "i2": ("r1", "no_change"), "i3": ("r2", "unexpected_run_id"), "i4": ("gone", "run")}


def test_validation_codes(spark):
    full = '{"canonical_person_id":"p","source":"s","source_file":"f","event_time":"t","run_id":"r","record_key":"k","schema_version":2}'
    texts = [full, full.replace('"run_id":"r",', ""), full.replace('"f"', '"John Doe.xml"'), " \t", "{cut", "[1]", full.replace("2}", '"2"}'), full.replace('"t"', "null"), full.replace("record_key", "event_key")]
    lines = spark.createDataFrame([("x.ndjson", i, t) for i, t in enumerate(texts)], "file string, line_no long, line string")
    got = [(r.line_no, r.code, r.detail) for r in quality.all_errors(lines, ["John"], [r"D[a-z]e\."]).collect()]
    assert got == [(1, "missing_required_key", "run_id"), (2, "banned_pattern", r"D[a-z]e\."), (2, "banned_token", "John"), (3, "empty_line", ""), (4, "invalid_json", ""), (5, "not_object", ""), (6, "invalid_type", "schema_version"), (7, "invalid_type", "event_time"), (8, "missing_required_key", "record_key")]
    one_by_one = quality.empty_lines(lines).unionByName(quality.banned(lines, ["John"], [r"D[a-z]e\."])).unionByName(quality.bad_json(lines)).unionByName(quality.required_keys(lines))
    assert sorted((r.line_no, r.code, r.detail) for r in one_by_one.collect()) == got
    assert [r.line_no for r in quality.all_errors(lines, [], []).collect()] == [1, 3, 4, 5, 6, 7, 8]


def test_redaction():
    redact = privacy.name_redactor([("John", "Doe", "Patient 1"), ("Ann", "O'Neil", "Patient 2")])
    assert redact("JOHN   doe met doe , john and Ann O'Neil; Johnny Doe, xJohn Doe") == "Patient 1 met Patient 1 and Patient 2; Johnny Doe, xJohn Doe"
    assert privacy.redact_json('{"John Doe":["John Doe",1,{"a":"x"}]}', redact) == '{"John Doe":["Patient 1",1,{"a":"x"}]}'
    assert privacy.redact_json("{cut John Doe", redact) == "{cut Patient 1"
    assert privacy.redact_patient('{"resourceType":"Patient","birthDate":"1980-01-02","contact":{"birthDate":"1"}}', "Patient 3") == '{"resourceType":"Patient","birthDate":"1900-01-01","contact":{"birthDate":"1"}}'
    out = privacy.redact_cda("<d><patientRole><patient><name use='L'><given>J</given></name><birthTime value='1980'/></patient><providerOrganization><name>Clinic</name></providerOrganization></patientRole><name>kept</name></d>", "Patient 1")
    assert out == '<d><patientRole><patient><name>Patient 1</name><birthTime value="19000101" /></patient><providerOrganization><name>Clinic</name></providerOrganization></patientRole><name>kept</name></d>'
    patient = '{"resourceType":"Patient","name":[{"text":"J D","given":["J"],"family":"D","use":"x"},"odd",{"family":"E"}]}'
    assert privacy.redact_patient(patient, "Patient 3") == '{"resourceType":"Patient","name":[{"text":"Patient 3","given":["Patient"],"family":"3","use":"x"},"odd",{"family":"3","text":"Patient 3","given":["Patient"]}]}'


def brute_redaction(people, text):
    """Person after person, every pattern over the whole text."""
    for first, last, label in people:
        for pattern in (rf"\b{re.escape(first)}\s+{re.escape(last)}\b", rf"\b{re.escape(last)}\s*,\s*{re.escape(first)}\b"):
            text = re.sub(pattern, label, text, flags=re.I)
    return text


def test_overlapping_names_go_by_label():
    people = [("Ann", "Lee", "Patient 1"), ("Mary", "Ann", "Patient 2"), ("Patient", "1", "Patient 3"), ("Jean-Luc", "van Dyke", "Patient 4"), ("O", "O", "Patient 5")]
    redact = privacy.name_redactor(people)
    for text in ("Mary Ann Lee", "Mary Ann", "van  Dyke,Jean-Luc and JEAN-LUC VAN DYKE", "Lee, Ann Mary Ann", "o o, O O o", "Ann\nLee Patient 1", "Ann Leeds", ""):
        assert redact(text) == brute_redaction(people, text)
    assert redact("Mary Ann Lee").startswith("Mary ")


def test_results_do_not_depend_on_how_names_are_met(spark, monkeypatch):
    people = spark.createDataFrame([("Ann", "Lee", "Patient 1"), ("Mary", "Ann", "Patient 2")], "first string, last string, label string")
    df = spark.createDataFrame([("Mary Ann Lee",), ("mary ann",)], "text string")
    for size in (0, 20_000):
        monkeypatch.setattr(privacy, "MOST_NAMES", size)
        assert [r.text for r in privacy.redact_names(df, "text", people).collect()] == ["Mary Patient 1", "Patient 2"]


def test_more_names_than_are_sent_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(privacy, "MOST_NAMES", 3)
    people = spark.createDataFrame([(f"First{i}", f"Last{i}", f"Patient {i}") for i in range(1, 11)], "first string, last string, label string")
    df = spark.createDataFrame([(i, f"saw Last{i}, First{i}", None) for i in range(1, 11)], "id int, text string, other string")
    assert {r.id: r.text for r in privacy.redact_names(df, "text", people).collect()} == {i: f"saw Patient {i}" for i in range(1, 11)}


def fold(rows):
    frame = pd.DataFrame([(h, ids, [""] * len(ids) if not linked else linked, name) for h, ids, linked, name in rows], columns=["hit", "ids", "linked", "name_person"])
    out = {r.hit: (r.person_key, r.state) for r in identity.fold(frame, "run").itertuples()}
    return out


def test_identity_fold():
    out = fold([(1, ["a"], None, None), (2, ["a", "b"], None, None), (3, ["b"], None, None), (4, ["b", "a"], None, None)])
    assert out[2] == (out[1][0], "verified") and out[3][1] == "new" and out[3][0] != out[1][0] and out[4] == (None, "conflict")
    out = fold([(1, ["a"], ["p9"], "other"), (2, ["c"], None, "p7"), (3, ["c"], None, None)])
    assert out == {1: ("p9", "verified"), 2: ("p7", "unverified"), 3: ("p7", "verified")}
    assert fold([(1, ["a"], None, None)]) == fold([(1, ["a"], None, None)])


def test_identity_over_components(spark, tmp_path):
    rows = [(1, ["a"], "x y"), (2, ["a", "b"], "x z"), (3, ["b"], "q r"), (4, ["k"], "s t"), (5, ["m"], "u v"), (6, ["n"], "u v")]
    hits = spark.createDataFrame(rows, "hit long, ids array<string>, name string")
    links = spark.createDataFrame([("k", "p1")], "id string, person string")
    names = spark.createDataFrame([("u v", "p5"), ("q r", "p6")], "name string, person string")
    got = {r.hit: (r.person_key, r.state) for r in identity.assign_persons(hits, links, names, "run", lambda d: d.cache()).collect()}
    assert got[2] == (got[1][0], "verified") and got[3] == ("p6", "unverified") and got[4] == ("p1", "verified")
    assert got[5][1] == got[6][1] == "new" and got[5][0] != got[6][0]  # a name that occurs twice in a run matches nobody


def test_identity_rounds_equal_the_fold(spark, tmp_path):
    """Hits that all hang together: the rounds give what one fold over all of them gives, and no task folds them."""
    import random
    import uuid

    def keep(df):
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rng = random.Random(6)
    rows = [(i, [f"a{rng.randrange(60)}", f"b{rng.randrange(90)}"], f"n{rng.randrange(150)}") for i in range(300)] + [(300, [], "alone"), (301, ["a1", "a1"], "twice")]
    links, names = {f"a{i}": f"p{i % 3}" for i in range(0, 60, 9)}, {f"n{i}": f"q{i}" for i in range(0, 150, 4)}
    count = {}
    for _, _, n in rows:
        count[n] = count.get(n, 0) + 1
    frame = pd.DataFrame([(h, ids, [links.get(i, "") for i in ids], names.get(n) if count[n] == 1 else None) for h, ids, n in rows], columns=["hit", "ids", "linked", "name_person"])
    want = {r.hit: (r.person_key, r.state) for r in identity.fold(frame, "run").itertuples()}
    assert {s for _, s in want.values()} == {"new", "verified", "unverified", "conflict"}
    out = identity.assign_persons(spark.createDataFrame(rows, "hit long, ids array<string>, name string"), spark.createDataFrame(list(links.items()), "id string, person string"), spark.createDataFrame(list(names.items()), "name string, person string"), "run", keep)
    assert {r.hit: (r.person_key, r.state) for r in out.collect()} == want
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def settled_by_turns(ids):
    taken, claims = set(), []
    for hit, own in ids:
        if not taken & set(own):
            taken |= set(own)
            claims += [(hit, i) for i in own]
    return sorted(claims)


def rounds_of(spark, tmp_path, ids):
    import uuid

    written = []

    def keep(df):
        written.append(f"{tmp_path}/{uuid.uuid4().hex}")
        df.write.parquet(written[-1])
        return spark.read.schema(df.schema).parquet(written[-1])

    given = spark.createDataFrame([(h, i) for h, own in ids for i in own], "hit long, id string")
    return sorted(map(tuple, identity.settled(given, keep).collect())), len(written)


def test_a_long_chain_of_hits_settles_in_few_rounds(spark, tmp_path):
    """Each of 10,000 hits shares an id with the one before: by turns every second one claims."""
    ids = [(h, [f"i{h}", f"i{h + 1}"]) for h in range(10_000)]
    got, tables = rounds_of(spark, tmp_path, ids)
    assert got == settled_by_turns(ids) and tables < 22


def test_chains_hubs_and_forks_settle_as_by_turns(spark, tmp_path):
    import random

    rng = random.Random(3)
    hub = [(h, ["hub", f"s{h}"]) for h in range(200)]
    fork = [(200 + h, [f"s{h}", f"t{h // 2}"]) for h in range(200)]
    chains = [(400 + h, [f"c{h % 5}-{h // 5}", f"c{h % 5}-{h // 5 + 1}"] + ([f"s{rng.randrange(200)}"] if h % 37 == 0 else [])) for h in range(400)]
    ids = hub + fork + chains
    got, tables = rounds_of(spark, tmp_path, ids)
    assert got == settled_by_turns(ids) and tables < 60


def test_joins_spread_frequent_keys(spark, monkeypatch):
    from vitalstream.operators import skew
    from vitalstream.operators.skew import spread_join

    monkeypatch.setattr(skew, "SMALL", 0)
    rows = spark.range(3000).selectExpr("CASE WHEN id < 2500 THEN 7 WHEN id < 2900 THEN id ELSE NULL END AS k", "id AS v")
    other = spark.createDataFrame([(7, "hot"), (2600, "once"), (1, "none"), (None, "null")], "k long, name string")
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(other, "k", how).collect()), key=str)
        out = spread_join(rows, other, ["k"], F.col("v"), 3000, per_task=100, how=how)
        assert sorted(map(tuple, out.collect()), key=str) == want
        assert sorted(map(tuple, spread_join(rows, other, ["k"], F.col("v"), 3000, per_task=5000, how=how).collect()), key=str) == want


def test_components_of_hubs_and_chains(spark, tmp_path, monkeypatch):
    import uuid

    from vitalstream.operators import skew
    from vitalstream.operators.graph import components

    monkeypatch.setattr(skew, "SMALL", 0)

    def keep(df):
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    links = [(0, i) for i in range(1, 1500)] + [(i, i + 1) for i in range(2000, 2040)] + [(5, 5), (3000, 2999)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), keep).collect()}
    assert got == {i: 0 for i in range(1500)} | {i: 2000 for i in range(2000, 2041)} | {2999: 2999, 3000: 2999}


def test_append_keeps_first_and_is_idempotent(spark):
    schema = "k string, n int, v string"
    new = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 3, None)], schema)
    once = keyed.append_if_absent(spark.createDataFrame([], schema), new, "k", "n")
    twice = keyed.append_if_absent(once, new, "k", "n")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str) == [("a", 1, "first"), ("b", 3, None)]


def test_note_lines(spark):
    from vitalstream.operators import reports
    from vitalstream.sources.tables import COLUMNS

    rows = [("observations", "1", "p", "healthkit", "f", "2020-01-01 00:00:00", "run1", "HKRate", None, None, None), ("observations", "2", "p", "cda", "f", None, "run1", None, None, "8867-4", None), ("documents", "3", "p", "fhir", "f", "2020-01-03 00:00:00", "run1", None, "DocumentReference", None, None)]
    ev = spark.createDataFrame(rows, ", ".join(f"{x} string" for x in COLUMNS)).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
    lines = [r.line for r in reports.clinical_note(ev).orderBy("ord").collect()]
    assert lines[1:8] == ["run_id=run1", "generated_at=2020-01-03T00:00:00Z", "people=1", "event_time_range=2020-01-01T00:00:00Z..2020-01-03T00:00:00Z", "totals.observations=2", "totals.documents=1", "totals.medications=0"]
    assert lines[8:12] == ["totals.conditions=0", "sources.healthkit=1", "sources.fhir=1", "sources.cda=1"]
    assert lines[12] == "signals.top_observations=HKRate:1;8867-4:1"
    empty = [r.line for r in reports.clinical_note(ev.limit(0)).orderBy("ord").collect()]
    assert empty[1:5] == ["run_id=unknown", "generated_at=1970-01-01T00:00:00Z", "people=0", "event_time_range="] and not any(re.match("signals", x) for x in empty)
