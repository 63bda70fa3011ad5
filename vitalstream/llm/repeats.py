"""Removal of repeated passages by distributed prefix doubling.

A string's rank is its place among the strings of its length. Prefix doubling sorts pairs, the rank of a string's first part
and what names its second part, at growing lengths; equal pairs have one rank, and what is alone is dropped. Spark sorts the
pairs by ranges and counts the earlier ranges' rows. The lengths:

1. FIRST bytes, at one place of each string of LENGTH bytes only: where their name is least of all in the string. Equal strings
   have equal such places, so where none is shared nothing repeats. Neighbouring strings mostly have the same place; they
   are one run.
2. A whole run: the rank of its place and the name of its bytes. Runs that repeat as a whole are decided. What remains are the
   ends of repeated passages: places whose surroundings differ somewhere among their occurrences. One run of each rank goes on.
3. STEP neighbouring strings of such a run, ranked by the bytes that all of them share and then by all their bytes: unique ones
   go, those that are the same all over are decided, and only from the others
4. strings of LENGTH bytes are compared one by one, by the rank of their first half and the name of the whole.

A name is a hash of 64 bits, computed inside a text from pairs of names at offsets 1, 2, 4, ..., 64; equality is told by two
names, so by 128 bits. Ranks for every byte of the corpus at those offsets would each be shuffled with it, many times the
size of the input; so ranks start at FIRST bytes. The texts are read twice more: for the runs that go to step 3, and to cut
the result. Joins on a rank spread a frequent one over several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import numbered
from ..operators.skew import spread_join
from .common import materialize, release

LENGTH = 200
FIRST = 64
REACH = LENGTH - FIRST + 1
STEP = 16
#: Bytes that are worked on at once (their names stay in a core's cache); longer texts are cut into overlapping parts of as
#: many string starts.
PART = 1 << 15
_PLACE = np.uint64((1 << 24) - 1)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(41).integers(0, 2**64, 256, dtype=np.uint64)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The names of strings from the names of their first and their last part."""
    x = a * _K1
    x += b
    x ^= x >> np.uint64(31)
    x *= _K2
    x ^= x >> np.uint64(29)
    return x


def doubled(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the strings of FIRST and of 128 bytes at every place, by pairs at offsets 1, 2, 4, ..., 64."""
    name, n = _BYTE[raw], 1
    first = name
    while n < 128:
        if n == FIRST:
            first = name
        name = joined(name[:-n], name[n:])
        n *= 2
    return first, name


def named(name128: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Names of strings of 128 to 384 bytes: of their first, middle and last 128 bytes, which overlap or meet."""
    last = start + length - 128
    return joined(joined(name128[start], name128[np.minimum(start + 128, last)]), name128[last]) + np.uint64(1) * np.asarray(length).astype(np.uint64)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    return np.minimum(v[: len(v) - (width - n)], v[width - n :]) if width > n else v


def runs(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, count, offset, place name, run name) of the runs of string starts in texts that stand one after another.

    offset is the distance of the common place from the first start. No run crosses an end of a text.
    """
    empty = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    if len(raw) < LENGTH:
        return empty
    first, name128 = doubled(raw)
    key = (first & ~_PLACE) | np.arange(len(first), dtype=np.uint64)
    at = (sliding_min(key, REACH) & _PLACE).astype(np.int64)
    start = np.arange(len(at))
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(at)]
    valid = start + LENGTH <= ends[text]
    new = np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1]))
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    begin, count = begin[valid[begin]], count[valid[begin]]
    return begin, count, at[begin] - begin, first[at[begin]], named(name128, begin, count + LENGTH - 1)


def parts(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """(bytes, text number, shift and end of each piece): texts side by side, about PART bytes at a time.

    A text that is longer is cut into pieces that overlap by LENGTH - 1 bytes, so that each string start is in one piece.
    """
    held, owner, shift, ends, size = [], [], [], [], 0
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text) - LENGTH + 1), PART):
            piece = text[a : a + PART + LENGTH - 1]
            held.append(piece)
            owner.append(i)
            shift.append(a)
            size += len(piece)
            ends.append(size)
            if size >= PART:
                yield b"".join(held), owner, shift, ends
                held, owner, shift, ends, size = [], [], [], [], 0
    if held:
        yield b"".join(held), owner, shift, ends


#: What tells texts apart: id and hash of id and text; equal rows share both.
KEY = ["id", "rid"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: '') and KEY."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.lit(-1).cast("long")).alias("id"), F.xxhash64(doc_id, text).alias("rid"))


def all_runs(texts: DataFrame) -> DataFrame:
    """(id, rid, s, n, off, place, run) of every text of keyed(): first start, count, offset, and the two names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [batch.column(i).to_numpy() for i in (0, 1)]
            for raw, owner, shift, ends in parts([t.encode() for t in batch.column(2).to_pylist()]):
                s, n, off, place, name = runs(np.frombuffer(raw, np.uint8), np.array(ends))
                piece = np.searchsorted(ends, s, side="right")
                begin = np.array([0, *ends[:-1]], np.int64)[piece] - np.array(shift, np.int64)[piece]
                own = np.array(owner, np.int64)[piece]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[0][own]), pa.array(key[1][own]), pa.array(s - begin), pa.array(n), pa.array(off), pa.array(place.view(np.int64)), pa.array(name.view(np.int64))],
                    [*KEY, "s", "n", "off", "place", "run"],
                )

    return texts.select(*KEY, "text").mapInArrow(run, "id long, rid long, s long, n long, off long, place long, run long")


def side_by_side(raws: list[bytes], *columns: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(names of 128 bytes, first bytes, numbers) of runs, and their columns: as many runs at a time as come to PART bytes."""
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    part = np.cumsum(sizes) // PART
    for a, z in zip(*(lambda cuts: (cuts, [*cuts[1:], len(raws)]))(np.flatnonzero(np.diff(part, prepend=-1)).tolist())):
        _, name128 = doubled(np.frombuffer(b"".join(raws[a:z]), np.uint8))
        yield name128, np.cumsum(sizes[a:z]) - sizes[a:z], np.arange(a, z), *(c[a:z] for c in columns)


def spread_out(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, value): each i with the values from low[i] to high[i]."""
    count = high - low + 1
    i = np.repeat(np.arange(len(low)), count)
    return i, low[i] + np.arange(len(i)) - (np.cumsum(count) - count)[i]


def _steps(raws: list[bytes], n: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(run number, step, first and last offset, core name, whole name) of the steps of runs whose bytes are raws.

    A string start is told by its offset, the distance to the run's place. All strings of a step hold its core; which of
    the step's offsets the run has is part of the whole name.
    """
    for name128, begin, number, own_n, own_off in side_by_side(raws, n, off):
        i, step = spread_out((own_off - own_n + 1) // STEP, own_off // STEP)
        lo, hi = np.maximum(step * STEP, (own_off - own_n + 1)[i]), np.minimum(step * STEP + STEP - 1, own_off[i])
        at = (begin + own_off)[i]
        core = named(name128, at - step * STEP, LENGTH - STEP + 1)
        whole = named(name128, at - hi, LENGTH + hi - lo)
        yield number[i], step, lo, hi, core, joined(whole, lo.astype(np.uint64) * np.uint64(1024) + hi.astype(np.uint64))


def counted(rows: DataFrame, *keys: str, **more: Column) -> DataFrame:
    """(keys, c, more): one row for each pair of keys, with the number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("c"), *[x.alias(k) for k, x in more.items()])


def found_in(rows: DataFrame, other: DataFrame, keys: list[str], number: str, *columns: str) -> DataFrame:
    """rows with columns of other by keys, a frequent key spread; number is other's column of how many rows a key has."""
    return spread_join(rows, other.select(*keys, *columns), keys, F.xxhash64(*[c for c in rows.columns if c not in keys]), rows.count(), per_task=20_000, counts=other.select(*keys, F.col(number).alias("_rows")))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(id, rid, s, n): n neighbouring starts, from s on, of strings that start elsewhere, too."""
    every = materialize(all_runs(texts))
    places = numbered(counted(every, "place").where("c > 1"), "rank", "place")
    live = materialize(found_in(every, places, ["place"], "c", "rank").drop("place"))
    release(every)  # the largest of the tables
    # The rank of a run: its place in the order of (rank of its first part, name of the whole).
    kinds = numbered(counted(live, "rank", "run", one=F.min(F.struct(*KEY, "s", "n", "off"))), "uid", "rank", "run")
    several = materialize(counted(kinds, "rank").where("c > 1").withColumnRenamed("c", "kinds"))
    sure = found_in(live, kinds.where("c > 1"), ["rank", "run"], "c").select(*KEY, "s", "n")
    open_runs = found_in(kinds.select("rank", "uid", "one", (F.col("c") == 1).alias("alone")), several, ["rank"], "kinds").select("one.*", "uid", "alone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, listed in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = text.as_py().encode()
                out += [(*(r[c] for c in ("uid", *KEY, "alone", "s", "n", "off")), raw[r["s"] : r["s"] + r["n"] + LENGTH - 1]) for r in listed]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 8, types)], ["uid", *KEY, "alone", "s", "n", "off", "raw"])

    by_text = open_runs.groupBy(*KEY).agg(F.collect_list(F.struct("uid", *KEY, "alone", "s", "n", "off")).alias("listed"))
    chosen = texts.join(by_text, KEY).select("text", "listed")
    opened = materialize(chosen.mapInArrow(cut, "uid long, id long, rid long, alone boolean, s long, n long, off long, raw binary").dropDuplicates(["uid"]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, n, off = (batch.column(i).to_numpy() for i in range(3))
            for number, *found in _steps(batch.column(3).to_pylist(), n, off):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (uid[number], *found)], ["uid", "step", "lo", "hi", "core", "whole"])

    stepped = materialize(opened.select("uid", "n", "off", "raw").mapInArrow(step, "uid long, step long, lo long, hi long, core long, whole long"))
    alike = materialize(counted(stepped, "core", "whole", uid=F.min("uid"), step=F.min("step")))
    mixed = counted(alike, "core").where("c > 1").withColumnRenamed("c", "kinds")
    mixed = numbered(mixed, "core_rank", "core")
    same = found_in(stepped, alike.where("c > 1"), ["core", "whole"], "c").select("uid", "lo", "hi")
    where = opened.where("alone").select("uid", *KEY, (F.col("s") + F.col("off")).alias("place"))
    sure_steps = same.join(where, "uid").select(*KEY, (F.col("place") - F.col("hi")).alias("s"), (F.col("hi") - F.col("lo") + 1).alias("n"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, n, off = (batch.column(i).to_numpy() for i in range(3))
            steps = batch.column(4).to_pylist()
            for name128, begin, number, own_n, own_off in side_by_side(batch.column(3).to_pylist(), n, off):
                listed = [steps[i] for i in number]
                i, step = np.repeat(np.arange(len(number)), list(map(len, listed))), np.array([x for some in listed for x in some], np.int64)
                j, offset = spread_out(np.maximum(step * STEP, (own_off - own_n + 1)[i]), np.minimum(step * STEP + STEP - 1, own_off[i]))
                start = (begin + own_off)[i][j] - offset
                columns = (uid[number][i][j], offset, name128[start].view(np.int64), named(name128, start, LENGTH).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["uid", "offset", "half", "name"])

    wanted = found_in(alike.select("core", "uid", "step"), mixed, ["core"], "kinds").groupBy("uid").agg(F.collect_set("step").alias("steps"))
    strings = materialize(opened.join(wanted, "uid").select("uid", "n", "off", "raw", "steps").mapInArrow(single, "uid long, offset long, half long, name long"))
    twice = materialize(counted(strings, "half", "name").where("c > 1"))
    last = found_in(strings, twice, ["half", "name"], "c").join(where, "uid").select(*KEY, (F.col("place") - F.col("offset")).alias("s"), F.lit(1).cast("long").alias("n"))
    return sure.unionByName(sure_steps).unionByName(last)


def covered(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the strings at the starts of spans cover."""
    out: list[list[int]] = []
    for a, z in sorted((x["s"], x["s"] + x["n"] + LENGTH - 1) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, min(z, size)) for a, z in out]


def spans_by_text(texts: DataFrame) -> DataFrame:
    """(id, rid, spans): the distinct runs of repeated_spans() of each text. Equal rows share a key and find the same runs, so a
    list is bounded by its text however many rows have it."""
    return repeated_spans(texts).groupBy(*KEY).agg(F.collect_set(F.struct("s", "n")).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed), one row per input row; removed lists the byte runs cut.

    A text is its UTF-8 bytes (null: empty). Every byte goes that a string of LENGTH bytes covers which also starts
    anywhere else, in the same or another text; equal rows repeat each other. Texts under LENGTH bytes stay whole.
    """
    texts = keyed(docs)
    spans = spans_by_text(texts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, listed in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_py().encode()
                gone = covered(listed or [], len(raw))
                digest, at = hashlib.sha256(), 0
                for a, z in gone:
                    digest.update(raw[at:a])
                    at = z
                digest.update(raw[at:])
                rows.append((len(raw), sum(z - a for a, z in gone), len(gone), digest.hexdigest(), [{"start": a, "end": z} for a, z in gone]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    joined_rows = texts.join(spans, KEY, "left").select("doc_id", "text", "spans")
    return joined_rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>")
