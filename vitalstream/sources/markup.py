"""Raw XML files of any size: Spark cuts them into byte ranges, and these readers see them piece by piece.

A piece ends with a `>`, so no tag is cut; Spark's text reader carries a piece that crosses the border of two ranges to the task
of the first one. Counts over pieces are therefore exact. Nested elements are read in two passes: the first tells of each range
which elements it closes and which it leaves open, which gives every range the elements it begins in; the second reads it.
Files so small that Spark never cuts them are one range, read in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import normalize_time
from .files import ONE_CELL, cda_observations

#: What is counted in raw exports.
START_TAG = r"<\s*([A-Za-z_][A-Za-z0-9_.:-]*)"
RECORD_TYPE = "<Record\\b[^>]*\\btype=[\"']([^\"']+)[\"']"
TOP_TAGS = 50


def pieces(spark: SparkSession, paths: str | list[str], which: Column | None = None) -> DataFrame:
    """(file, start, piece): the files' text cut behind each `>`, which the piece is without; start is that of its byte range.
    which chooses files by their _metadata."""
    raw = spark.read.option("lineSep", ">").option("recursiveFileLookup", "true").text(paths)
    raw = raw if which is None else raw.where(which)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("piece"))


def start_tags(cut: DataFrame, most: int = TOP_TAGS) -> DataFrame:
    """(tag, n) of the most frequent start tags, prefixes dropped."""
    tags = cut.select(F.explode(F.regexp_extract_all("piece", F.lit(START_TAG), F.lit(1))).alias("t"))
    return tags.groupBy(F.regexp_replace("t", "^[^:]*:", "").alias("tag")).agg(F.count("*").alias("n")).where("tag <> ''").orderBy(F.desc("n"), "tag").limit(most)


def record_types(cut: DataFrame) -> DataFrame:
    """(hk_type, n) of the device records with a type; the types are not parsed as XML."""
    types = cut.select(F.explode(F.regexp_extract_all("piece", F.lit(RECORD_TYPE), F.lit(1))).alias("t")).select(F.trim("t").alias("hk_type"))
    return types.where("hk_type <> ''").groupBy("hk_type").agg(F.count("*").alias("n"))


def record_estimates(cut: DataFrame, by: Column) -> DataFrame:
    """(by, records, newlines): starts of device records and line ends."""
    return cut.groupBy(by).agg(F.sum(F.regexp_count("piece", F.lit("<Record"))).alias("records"), F.sum(F.regexp_count("piece", F.lit("\n"))).alias("newlines"))


#: What a range can begin in. A `>` inside an attribute's value is told apart within a range only.
MODES = ("text", "comment", "cdata", "instruction")
_END = {"comment": "--", "cdata": "]]", "instruction": "?"}
_BEGIN = (("!--", "comment"), ("![CDATA[", "cdata"), ("?", "instruction"))
_QUOTED = re.compile(r"[^\"']*(?:\"[^\"]*\"[^\"']*|'[^']*'[^\"']*)*")
_NAME = re.compile(r"[^\s/]+")
_ATTRIBUTE = re.compile(r"([^\s=\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_REFERENCE = re.compile(r"&(?:#x([0-9A-Fa-f]+)|#([0-9]+)|(amp|lt|gt|quot|apos));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
Event = tuple[str, str, str, bool]


def attributes(text: str) -> dict[str, str]:
    of = lambda m: chr(int(m[1], 16)) if m[1] else chr(int(m[2])) if m[2] else _NAMED[m[3]]
    return {k: _REFERENCE.sub(of, re.sub(r"[\t\r\n]", " ", a or b)) for k, a, b in _ATTRIBUTE.findall(text)}


class Reader:
    """The tags of a range in order. mode says what it is in after a piece."""

    def __init__(self, mode: str = "text"):
        self.mode, self.part = mode, ""

    def read(self, piece: str) -> Event | None:
        """('start' or 'end', local name, attribute text, self-closing), or None if the piece holds no tag."""
        if self.part:
            piece, self.part = f"{self.part}>{piece}", ""
        elif self.mode != "text":
            if piece.endswith(_END[self.mode]):
                self.mode = "text"
            return None
        at = piece.find("<")
        if at < 0:
            return None
        tag = piece[at + 1 :]
        for begin, mode in _BEGIN:
            if tag.startswith(begin):
                if len(tag) < len(begin) + len(_END[mode]) or not tag.endswith(_END[mode]):
                    self.mode = mode
                return None
        if tag.startswith("!"):
            if tag.count("[") > tag.count("]"):
                self.part = piece  # a document type with a subset goes on
            return None
        if _QUOTED.match(tag)[0] != tag:
            self.part = piece  # a `>` inside a value
            return None
        if tag.startswith("/"):
            return "end", tag[1:].strip().rpartition(":")[2], "", False
        name = _NAME.match(tag)
        return name and ("start", name[0].rpartition(":")[2], tag[name.end() :], tag.endswith("/"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The pieces of each byte range of a task; a task reads one range after the other."""
    rows = ((file, start, piece) for batch in batches for file, start, piece in zip(*(batch.column(i).to_pylist() for i in range(3))))
    row = next(rows, None)
    while row:
        key = row[:2]

        def own() -> Iterator[str]:
            nonlocal row
            while row and row[:2] == key:
                yield row[2]
                row = next(rows, None)

        yield key, own()


_SUMMARY = "file string, start long, mode string, ends_in string, closed array<string>, opened array<struct<name:string,no:long>>, wrong boolean"


def _summaries(cut: DataFrame) -> DataFrame:
    """Of each range, for each mode it may begin in: the mode it ends in, the names of the outer elements that it closes, and
    the elements it leaves open, observations with their number in the range (else -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), own in _by_range(batches):
            modes = MODES if start else MODES[:1]  # a file begins in text
            readers = [Reader(m) for m in modes]
            states = [([], [], [0], [False]) for _ in modes]  # closed, opened, observations so far, wrong
            for piece in own:
                for reader, (closed, opened, count, wrong) in zip(readers, states):
                    if not (event := reader.read(piece)):
                        continue
                    kind, name, _, empty = event
                    if kind == "start":
                        no = count[0] if name == "observation" else -1
                        count[0] += name == "observation"
                        if not empty:
                            opened.append((name, no))
                    elif opened:
                        wrong[0] |= opened.pop()[0] != name
                    else:
                        closed.append(name)
            rows = [(file, start, m, r.mode, s[0], [{"name": n, "no": k} for n, k in s[1]], s[3][0]) for m, r, s in zip(modes, readers, states)]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("name", pa.string()), ("no", pa.int64())])), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in ("file", "start", "mode", "ends_in", "closed", "opened", "wrong")])

    return cut.mapInArrow(run, _SUMMARY)


_BEGINNING = "file string, start long, mode string, stack array<struct<range:long,no:long>>"


def _beginnings(summaries: DataFrame) -> DataFrame:
    """(file, start, mode, stack): what each range of a well-formed file begins in. A file's summaries meet in one group: a row
    per range, each as long as the document is deep."""

    def fold(rows: pa.Table) -> pa.Table:
        by = {(r["start"], r["mode"]): r for r in rows.to_pylist()}
        mode, stack, out, wrong = "text", [], [], False
        for start in sorted({s for s, _ in by}):
            r = by[start, mode]
            out.append((r["file"], start, mode, [{"range": a, "no": b} for _, a, b in stack]))
            wrong |= r["wrong"] or len(r["closed"]) > len(stack) or [x[0] for x in stack[::-1][: len(r["closed"])]] != r["closed"]
            stack = stack[: len(stack) - len(r["closed"])] + [(x["name"], start, x["no"]) for x in r["opened"]]
            mode = r["ends_in"]
        if wrong or stack or mode != "text":
            out = []
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("range", pa.int64()), ("no", pa.int64())]))]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)], ["file", "start", "mode", "stack"])

    return summaries.groupBy("file").applyInArrow(fold, _BEGINNING)


_PART = "file string, range long, no long, name string, seen_range long, seen_no long, a string, b string"


def large_cda_observations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, event_time, code, value, unit) of every observation element of clinical documents of any size, in UTF-8.

    As cda_observations(), but a document is read by many tasks, range by range. An observation whose parts lie in several
    ranges is put together by its place. A document whose tags do not match gives no row.
    """
    cut = pieces(spark, paths)
    begin = _beginnings(_summaries(cut)).collect()  # a row per byte range, as Spark's own list of ranges
    known = spark.sparkContext.broadcast({(r.file, r.start): (r.mode, [(x["range"], x["no"]) for x in r.stack]) for r in begin})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _PART.split(", ")])
        for (file, start), own in _by_range(batches):
            mode, stack = known.value.get((file, start), (None, []))
            reader, stack, count, rows = Reader(mode or "text"), list(stack), 0, []
            for n, piece in enumerate(own):
                if mode is None or not (event := reader.read(piece)):
                    continue
                kind, name, text, empty = event
                if kind == "end":
                    stack.pop()
                    continue
                if name in ("effectiveTime", "code", "value") and stack and stack[-1][1] >= 0:
                    given = attributes(text)
                    rows.append((file, *stack[-1], name, start, n, given.get("code" if name == "code" else "value"), given.get("unit")))
                here = (start, count if name == "observation" else -1)
                if name == "observation":
                    rows.append((file, *here, name, start, n, None, None))
                    count += 1
                if not empty:
                    stack.append(here)
                if len(rows) >= 10_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    parts = cut.mapInArrow(run, _PART)
    first = lambda name, c: F.min_by(F.struct(c), F.when(F.col("name") == name, F.struct("seen_range", "seen_no")))[c]
    found = parts.groupBy("file", "range", "no").agg(first("effectiveTime", "a").alias("time"), first("code", "a").alias("code"), first("value", "a").alias("value"), first("value", "b").alias("unit"))
    return found.select("file", normalize_time(F.col("time")).alias("event_time"), "code", "value", "unit")


def never_cut(spark: SparkSession) -> int:
    """Files up to so many bytes are one range: Spark cuts files into no smaller ones."""
    given = spark._jsparkSession.sessionState().conf()
    return min(given.filesMaxPartitionBytes(), given.filesOpenCostInBytes())


def uncut_cda_observations(cut: DataFrame) -> DataFrame:
    """(file, event_time, code, value, unit) of every observation element of documents of one range, from their pieces. A
    document's rows are kept until its end shows that its tags match."""
    names = ["file", "time", "code", "value", "unit"]

    def of(own: Iterator[str]) -> list[dict[str, dict[str, str]]]:
        reader, stack, found, right = Reader(), [], [], True
        for piece in own:
            if not right or not (event := reader.read(piece)):
                continue
            kind, name, text, empty = event
            if kind == "end":
                right = bool(stack) and stack.pop()[0] == name
                continue
            if name in ("effectiveTime", "code", "value") and stack and stack[-1][1] is not None and name not in stack[-1][1]:
                stack[-1][1][name] = attributes(text)
            here = {} if name == "observation" else None
            if here is not None:
                found.append(here)
            if not empty:
                stack.append((name, here))
        return found if right and not stack and reader.mode == "text" else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 5)], names)
        for (file, _), own in _by_range(batches):
            get = lambda parts, name, key: parts.get(name, {}).get(key)
            rows += [(file, get(p, "effectiveTime", "value"), get(p, "code", "code"), get(p, "value", "value"), get(p, "value", "unit")) for p in of(own)]
            if len(rows) >= 10_000:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)

    found = cut.mapInArrow(run, ", ".join(f"{n} string" for n in names))
    return found.select("file", normalize_time(F.col("time")).alias("event_time"), "code", "value", "unit")


def all_cda_observations(spark: SparkSession, root: str, one_cell: int = ONE_CELL) -> DataFrame:
    """(file, event_time, code, value, unit) of all clinical documents below root: those up to one_cell bytes are parsed as a
    whole, larger ones range by range."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    size, uncut = F.col("_metadata.file_size"), never_cut(spark)
    out = cda_observations(files.where(size <= one_cell).select(F.col("path").alias("file"), "content"))
    if one_cell < uncut:
        one = uncut_cda_observations(pieces(spark, root, (size > one_cell) & (size <= uncut)))
        out = out.unionByName(one) if one_cell > 0 else one  # an empty file has no observations
    large = [r.path for r in files.where(size > max(one_cell, uncut)).select("path").collect()]
    return out.unionByName(large_cda_observations(spark, large)) if large else out
