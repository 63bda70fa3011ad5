"""MinHash near-dedup with circulant permutations.

One permutation sends shingles to places of a circle of D places; a second one, read at successive circular shifts, gives
all signature coordinates. Coordinates are cut into bands; documents that share a band are candidates, and links are
confirmed by the exact Jaccard similarity of the full shingle sets.

Documents with equal sets are one class and only the class takes part. Inside a band's bucket each class is first compared
with the bucket's smallest class, which links a group of copies of any size by one row per member. Only pairs of a bucket
that are still in different components after that are compared one by one, in blocks, first by longer signatures (LONG
coordinates, a byte of each): those whose estimate is more than 4.5 standard deviations below the threshold are passed
over, which loses fewer than one link in 100,000; the rest are confirmed on the full sets like the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from .common import components, free_names, materialize, pieces, release
from .runs import dealt_pairs, key_runs, pairs_of_chunks

SHINGLE_WORDS = 5
BANDS, ROWS = 24, 4
PLACES = 1 << 18
LONG = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Entries of a task's table of word hashes; beyond, it starts anew. A longer word than MEMO_BYTES is not kept.
MEMO, MEMO_BYTES = 131_072, 64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _word_hashes(words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    known = memo.get

    def new(word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            if len(memo) >= MEMO:
                memo.clear()
            memo[word] = h
        return h

    return np.fromiter((known(w) or new(w) for w in words), np.uint64, len(words))


def shingle_hashes(text: str | None, memo: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text; of the whole sequence if it has fewer words.

    memo is a task's table of word hashes. It ends with the task: a Python worker goes on to tasks of other operators.
    """
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = _word_hashes(words, {} if memo is None else memo)
    n = max(1, len(h) - SHINGLE_WORDS + 1)
    s = np.full(n, min(len(h), SHINGLE_WORDS), np.uint64)
    for j in range(min(len(h), SHINGLE_WORDS)):
        s = mixed(s ^ h[j : j + n])
    return np.unique(s)


class Circulant:
    """The signature of shingle sets: coordinate k is the least value of the second permutation, shifted by k places."""

    def __init__(self, coordinates: int = BANDS * ROWS, places: int = PLACES, seed: int = 17):
        second = np.random.default_rng(seed).permutation(places).astype(np.uint32)
        self.k, self.places = coordinates, places
        self.around = np.concatenate([second, second[:coordinates]])

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, coordinates) of non-empty sets."""
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        place = (mixed(flat) % np.uint64(self.places)).astype(np.intp)  # the first permutation: a hash to a place
        out = np.empty((len(sets), self.k), np.uint32)
        for k in range(self.k):
            out[:, k] = np.minimum.reduceat(self.around[k:].take(place), starts)
        return out

    def bands(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, BANDS) keys of the bands."""
        signature = self.signatures(sets).astype(np.uint64).reshape(len(sets), BANDS, ROWS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS))
        for r in range(ROWS):
            key = mixed(key ^ signature[:, :, r])
        return key.view(np.int64)


def sketches(docs: DataFrame, lead: str = "doc_id", chunk_shingles: int = 200_000) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, bands, lead): set_key is a digest of the full set, null (as bands) if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle, memo = Circulant(), {}
        for batch in (piece for whole in batches for piece in pieces(whole, 1)):
            sizes, digests, bands = [], [], []
            held: list[np.ndarray] = []

            def flush() -> None:
                full = [s for s in held if len(s)]
                keys = iter(circle.bands(full).tolist()) if full else iter(())
                bands.extend(next(keys) if len(s) else None for s in held)
                held.clear()

            for value in batch.column(1):
                s = shingle_hashes(value.as_py(), memo)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                held.append(s)
                if sum(map(len, held)) > chunk_shingles if len(held) % 16 == 0 or len(s) > chunk_shingles else False:
                    flush()
            flush()
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_key", "bands", "lead"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"), F.col(f"`{lead}`").try_cast("long").alias("lead"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, lead long")


def confirmed(texts: DataFrame, pairs: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) of ids whose texts' full shingle sets have 100 * |intersection| >= percent * |union|.

    Texts go to their pairs by joins on the ids; a text that meets many others is read with each of them, in Spark's
    streams, and its set is kept while the next pair has it again.
    """
    left, right = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple[int, np.ndarray]] = {}
        memo: dict[bytes, int] = {}

        def of(side: str, i: int, text: pa.Scalar) -> np.ndarray:
            if last.get(side, (None,))[0] != i:
                last[side] = (i, shingle_hashes(text.as_py(), memo))
            return last[side][1]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(a, b)):
                s, t = of("a", x, batch.column(2)[i]), of("b", y, batch.column(3)[i])
                if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return joined.mapInArrow(run, "a long, b long")


def alike(texts: DataFrame, members: DataFrame, percent: int = 75, chunk_rows: int = 256) -> DataFrame:
    """(a, b): the pairs of members (bucket, rep, n, hub, component) that share a bucket but no component and may be links.

    A pair is looked at in one bucket only, the first that both are in; pairs with a hub have been confirmed before.
    """
    least = percent / 100 - 4.5 * np.sqrt(percent / 100 * (1 - percent / 100) / LONG)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle, memo = Circulant(LONG, seed=18), {}
        for batch in (piece for whole in batches for piece in pieces(whole, 1)):
            sets = [shingle_hashes(t.as_py(), memo) for t in batch.column(1)]
            short = Circulant()
            long = [circle.signatures([s])[0].astype(np.uint8).tobytes() for s in sets]
            bands = [short.bands([s])[0].tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(long, pa.binary()), pa.array(bands, pa.binary())], ["rep", "long", "bands"])

    wanted = texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sketched = materialize(wanted.select("doc_id", "text").mapInArrow(sketch, "rep long, long binary, bands binary"))
    dealt = dealt_pairs(members, "bucket", F.col("rep"), chunk_rows, sketched, "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in key_runs(batches, ["bucket", "i", "j"], 4 * chunk_rows):
            a, b = pairs_of_chunks(rows, starts)
            rep, n, hub, component, bucket = (rows[c].to_numpy() for c in ("rep", "n", "hub", "component", "bucket"))
            use = (component[a] != component[b]) & (rep[a] != hub[a]) & (rep[b] != hub[b])
            use &= 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            a, b = a[use], b[use]
            long = np.frombuffer(b"".join(rows["long"].to_pylist()), np.uint8).reshape(len(rep), LONG)
            bands = np.frombuffer(b"".join(rows["bands"].to_pylist()), np.int64).reshape(len(rep), BANDS)
            for at in range(0, len(a), 20000):
                x, y = a[at : at + 20000], b[at : at + 20000]
                near = (long[x] == long[y]).mean(1) >= least
                x, y = x[near], y[near]
                common = bands[x] == bands[y]
                first = bands[x, common.argmax(1)] == bucket[x]
                x, y = rep[x[first]], rep[y[first]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, lead: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row. Of several classes that may be alike, that of the
    smallest lead (long) is met by the others first; it changes the work, not the result.

    component_id is the smallest doc_id that links reach. Empty sets (null, empty or blank texts) and rows without an id
    link with nothing; a row without an id has no component and is kept. Rows with equal ids and texts have equal results;
    of several texts under one id, links of any count for the id. Other columns are ignored.
    """
    found = materialize(sketches(docs, lead))
    total = found.count()
    # A class, all rows of one set, goes by a number of its own: several texts under one id are several classes.
    filled = found.where("set_key is not null and doc_id is not null").withColumn("rep", F.xxhash64("set_key"))
    classes = filled.groupBy("rep", "set_key").agg(F.count("*").alias("_rows"), F.min("n_shingles").alias("n"), F.min(F.struct("doc_id", "text_hash", "bands")).alias("first"), F.min("lead").alias("lead"))
    classes = materialize(classes.select("rep", "set_key", "_rows", "n", "lead", "first.*"))
    bands = classes.select("rep", "n", "lead", "doc_id", F.explode("bands").alias("bucket"))
    # A bucket's hub is the class of its smallest id: the first of a group of copies, which all are like, rather than one of them.
    hubs = bands.groupBy("bucket").agg(F.min(F.struct(F.col("lead").isNull().alias("none"), "lead", "doc_id", "rep"))["rep"].alias("hub"), F.count("*").alias("members")).where("members > 1").select("bucket", "hub")
    members = materialize(bands.join(hubs, "bucket").select("bucket", "rep", "n", "hub"))
    # The texts of classes that share a bucket with another are all that is compared from here on, one of each class.
    wanted = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "text_hash")
    given = docs.select(F.col("doc_id").cast("long"), "text").withColumn("text_hash", F.xxhash64("text"))
    texts = materialize(given.join(wanted, ["doc_id", "text_hash"]).select(F.col("rep").alias("doc_id"), "text").dropDuplicates(["doc_id"]))
    star = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    first = materialize(confirmed(texts, star, percent))
    groups = materialize(components(first))
    grouped = members.join(groups, members["rep"] == groups["id"], "left").select("bucket", "rep", "n", "hub", F.coalesce("component", "rep").alias("component"))
    unlike = grouped.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    second = materialize(confirmed(texts, materialize(alike(texts, materialize(grouped.join(unlike, "bucket", "left_semi")), percent)), percent))
    # Classes that share an id are linked by it.
    several = filled.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    links = first.unionByName(second)
    if not several.isEmpty():
        owned = filled.select("doc_id", "rep").distinct()
        links = links.unionByName(spread_join(owned, several, ["doc_id"], F.col("rep"), total).where("a <> rep").select("a", F.col("rep").alias("b")).distinct())
    joined = components(links)
    placed = classes.join(joined, classes["rep"] == joined["id"], "left").select("set_key", "_rows", "doc_id", F.coalesce("component", "rep").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    # A large component's classes spread over tasks, as do the copies of a class.
    named = materialize(spread_join(placed, least, ["component"], F.col("set_key"), classes.count()).select("set_key", "_rows", "component_id"))
    for done in (members, texts, first, groups, second, classes):
        release(done)
    out = spread_join(found.drop("bands", "text_hash", "lead"), named.drop("_rows"), ["set_key"], F.col("doc_id"), total, how="left", counts=named.select("set_key", "_rows"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs that near_duplicates keeps: one id of each group, all rows without an id."""
    dropped = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("d_id")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["d_id"], "left_anti")


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of docs of each group of near copies: the one of the smallest doc_id, any of those without one if none has.

    Rows are told apart by a number of their own, so repeated rows and rows without an id are copies like others. Rows
    with empty sets (null, empty or blank texts) stay, each of them.
    """
    columns = docs.columns
    (no,) = free_names(docs, "row_no")
    numbered = materialize(docs.withColumn(no, F.monotonically_increasing_id()))
    # Rows come in any order, in which a copy of a copy may be the first; the ids lead, as in near_duplicates() by itself.
    groups = near_duplicates(numbered.select(F.col(f"`{no}`").alias("doc_id"), "text", F.col("doc_id").alias("lead_id")), percent, "lead_id").select(F.col("doc_id").alias("row"), "component_id")
    ids = numbered.select(F.col(f"`{no}`").alias("row"), "doc_id")
    first = groups.join(ids, "row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("kept_row"))
    return numbered.join(first, numbered[no] == first["kept_row"], "left_semi").select(*[F.col(f"`{c}`") for c in columns])
