"""Raw XML files read in byte ranges: exact whatever the cuts."""

import random
import re
from collections import Counter

import pytest

from vitalstream.sources import files, markup


@pytest.fixture(params=[251, 1 << 20])
def cuts(spark, request):
    """Ranges of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], request.param)
    spark.conf.set(keys[1], 0)
    yield request.param
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def document(rng, depth=0):
    """A random element tree with observations inside observations."""
    out = []
    for _ in range(rng.randint(1, 4)):
        name = rng.choice(["observation", "h:observation", "entry", "section"])
        parts = []
        if name.endswith("observation"):
            q = rng.choice("'\"")
            parts = [f"<code code={q}c{rng.randint(0, 9)}{q}/>", "<effectiveTime\n value='20200101112233' />", f"<h:value xsi:type='PQ' unit='a&amp;b &#60;' value={q}{rng.randint(0, 99)}{q}></h:value>", "<code code='second'/>", "<text>value='x' &gt; code</text>", "<!-- <observation> <code code='no'/> -->", "<![CDATA[ <observation> ]] > ]]>", "<?x <observation>?>"]
            parts = rng.sample(parts, rng.randint(0, len(parts)))
        if depth < 4:
            parts.insert(rng.randint(0, len(parts)), document(rng, depth + 1))
        out.append(f"<{name} a='1'>{chr(10).join(parts)}</{name}>")
    return "".join(out)


def test_observations_equal_the_parser(spark, cuts, tmp_path):
    rng = random.Random(cuts)
    for i in range(3):
        (tmp_path / f"d{i}.xml").write_text(f"<?xml version='1.0'?><!DOCTYPE d [<!ELEMENT x ANY>]><ClinicalDocument xmlns:h='u' xmlns:xsi='v'>{document(rng)}</ClinicalDocument>\n")
    (tmp_path / "cut.xml").write_text("<a><observation><code code='x'/></observation>" * 9)
    (tmp_path / "crossed.xml").write_text("<a><observation><code code='x'/></a></observation>" + " " * 300)
    (tmp_path / "empty.xml").write_text("")
    (tmp_path / "one.xml").write_text("<observation/>")
    whole = files.cda_observations(files.cda_documents(spark, str(tmp_path))).collect()
    ranged = markup.large_cda_observations(spark, [str(tmp_path)]).collect()
    key = lambda r: repr((r.file.rpartition("/")[2], r.event_time, r.code, r.value, r.unit))
    assert len(whole) > 20 and sorted(map(key, ranged)) == sorted(map(key, whole))
    assert sorted(map(key, markup.all_cda_observations(spark, str(tmp_path), one_cell=20).collect())) == sorted(map(key, whole))


def test_a_gt_inside_a_value(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<d><observation><code a='x>y' code=\"a>b\"/><value value='1'/></observation></d>")
    assert [(r.code, r.value) for r in markup.large_cda_observations(spark, [str(tmp_path)]).collect()] == [("a>b", "1")]


def test_counts_over_ranges(spark, cuts, tmp_path):
    rng = random.Random(1)
    lines = [rng.choice(['<Record type="HKa" x="1"/>', "<Record\n x='1' type=\"HKb\">", "</Record>", "<h:Recording/>", "< p>text", "<Record/>", '<Workout type="w"/>', "\n\n", "é", '<Record xtype="no"/>', '<Record type=" "/>']) for _ in range(900)]
    text = "".join(lines)
    (tmp_path / "a.xml").write_text(text)
    (tmp_path / "b.xml").write_text(text[:500] + "<Record")
    both = [text, text[:500] + "<Record"]
    cut = markup.pieces(spark, str(tmp_path))
    assert cuts > 100 or cut.rdd.getNumPartitions() > 8
    tags = Counter(t.partition(":")[2] or t for x in both for t in re.findall(r"<\s*([A-Za-z_][A-Za-z0-9_.:-]*)", x))
    assert {r.tag: r.n for r in markup.start_tags(cut).collect()} == tags
    types = Counter(t for x in both for t in re.findall(r"<Record\b[^>]*\btype=\"([^\"]+)\"", x) if t.strip())
    assert {r.hk_type: r.n for r in markup.record_types(cut).collect()} == types
    got = {r.file[-5:]: (r.records, r.newlines) for r in markup.record_estimates(cut, cut["file"]).collect()}
    assert got == {f"{n}.xml": (x.count("<Record"), x.count("\n")) for n, x in zip("ab", both)}


def test_documents_of_one_range_are_read_once(spark, tmp_path, monkeypatch):
    """Small documents need no first pass and no shuffle; ones whose tags do not match give no row."""
    rng = random.Random(7)
    for i in range(3):
        (tmp_path / f"d{i}.xml").write_text(f"<ClinicalDocument xmlns:h='u' xmlns:xsi='v'>{document(rng)}</ClinicalDocument>\n")
    for name, text in (("cut", "<a><observation><code code='x'/></observation>"), ("crossed", "<a><observation><code code='x'/></a></observation>"), ("more", "<a><observation/></a></b>"), ("open", "<a><observation/></a><!-- "), ("empty", "")):
        (tmp_path / f"{name}.xml").write_text(text)
    whole = files.cda_observations(files.cda_documents(spark, str(tmp_path))).collect()
    monkeypatch.setattr(markup, "large_cda_observations", lambda *_: pytest.fail("read in two passes"))
    ranged = markup.all_cda_observations(spark, str(tmp_path), one_cell=0)
    assert "Exchange" not in ranged._jdf.queryExecution().executedPlan().toString()
    key = lambda r: repr((r.file.rpartition("/")[2], r.event_time, r.code, r.value, r.unit))
    assert len(whole) > 20 and sorted(map(key, ranged.collect())) == sorted(map(key, whole))
