"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions; for each of the 255 decision nodes the contexts are the 0 to DEPTH bytes before it. A
context's Krichevsky-Trofimov estimate is mixed with that of its longer contexts by context-tree weighting, over all depths.
The tree is trained once and then fixed: the weight of stopping at a context is its share in the weighted block probability.
A context never seen in training leaves the estimate to its longest seen suffix.

How it runs: documents fall into blocks. A block lists its distinct (DEPTH + 1)-grams, packed into one integer each, and its
distinct words, with their counts in training, cut into buckets: a bucket of grams holds whole subtrees, each of one pair of
last two bytes and a SPLITth of the bytes before them. Merged over all blocks, a bucket's list is its part of the model. The
subtrees' roots are added up to the contexts of two bytes, a table; what lies above (256 contexts of one byte and the empty
one) is of fixed size and broadcast. Then each bucket meets the blocks' lists of its keys once more, answers each key, and
the answers go back to the blocks, which sum them over their documents. The model never leaves the buckets, however many
contexts the corpus has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_block, materialize

DEPTH = 5
END = b"\n"  # closes a text; words hold no white space, so it is no part of one
HALF = log(0.5)
#: Documents of about so many characters, and about so many of them at most, make a block.
BLOCK_CHARS = 8 << 20
BLOCK_ROWS = 20_000
#: Equal rows that come to more than this part of a block, by number or characters, are scored as one row with a count.
REPEATED = 16
EXPANDED = 10_000
#: Into how many subtrees a context of two bytes is cut, by the byte before it.
SPLIT = 8
#: So many lists of a bucket are merged at once, and so many bytes of lists are answered at once.
MERGED_BLOCKS = 64
ASKED_BYTES = 64 << 20
#: Keys whose subtree is worked on at once, but for larger subtrees of three bytes.
SEGMENT = 50_000
#: Bytes of text that a task packs at once.
PACKED = 16 << 20


# ---- grams and words of a block


def closed(words: list[bytes]) -> bytes:
    """A text as the tree reads it: its words, each closed by a blank, and END; DEPTH ENDs stand before it."""
    return END * DEPTH + b" ".join(words) + (b" " if words else b"") + END


def grams(raw: bytes) -> np.ndarray:
    """(context, byte) of each byte of closed(), packed: the latest byte of the context highest and the byte itself lowest,
    so that keys sort by subtree."""
    a = np.frombuffer(raw, np.uint8).astype(np.int64)
    n = len(a) - DEPTH
    key = a[DEPTH - 1 : DEPTH - 1 + n].copy()
    for back in range(2, DEPTH + 1):
        key <<= 8
        key |= a[DEPTH - back : DEPTH - back + n]
    key <<= 8
    key |= a[DEPTH:]
    return key


def word_keys(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the top bit clear, and -1 for the end of the text, which is no word's."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.append((h >> np.uint64(1)).view(np.int64), -1)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers of at least 0 as bytes: byte by byte of all of them, so that what is alike is side by side, compressed."""
    return pa.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def key_list(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return squeezed(np.diff(keys, prepend=0))


def listed_keys(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unsqueezed(blob, n))


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, int)
    return k[first], np.add.reduceat(c, first) if len(k) else c


class Gathered:
    """Distinct keys with counts, merged now and then so that memory follows the distinct keys."""

    def __init__(self) -> None:
        self.raw: list[np.ndarray] = []
        self.repeated: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, times: int = 1) -> None:
        if times > 1:
            k, c = np.unique(keys, return_counts=True)
            self.repeated.append((k, c * times))
        else:
            self.raw.append(keys)
        self.size += len(keys)
        if self.size > 4_000_000:
            self.merge()

    def merge(self) -> None:
        if self.raw or self.repeated:
            more = [np.unique(np.concatenate(self.raw), return_counts=True)] if self.raw else []
            self.keys, self.counts = merged(*map(list, zip((self.keys, self.counts), *more, *self.repeated)))
            self.raw, self.repeated, self.size = [], [], 0


def buckets_of(keys: np.ndarray, words: bool, buckets: int) -> np.ndarray:
    """The bucket of each key: of grams by the last two context bytes and a part of the third, of words by hash, above them."""
    if words:
        return buckets + keys % buckets
    h = ((keys >> (8 * (DEPTH - 1))) * SPLIT + (keys >> (8 * (DEPTH - 2))) % SPLIT).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def segments(keys: np.ndarray) -> list[tuple[int, int]]:
    """Cuts of sorted grams into runs of about SEGMENT that hold whole contexts of three bytes."""
    third = keys >> (8 * (DEPTH - 2))
    begins = np.flatnonzero(np.append(True, third[1:] != third[:-1])) if len(keys) else np.empty(0, int)
    cuts, last = [], None
    for at in begins.tolist():
        if last is None or at - last >= SEGMENT:
            cuts.append(at)
            last = at
    return list(zip(cuts, [*cuts[1:], len(keys)]))


# ---- a subtree


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return _lgamma_half(n0) + _lgamma_half(n1) - _lgamma_one(n0 + n1) - log(np.pi)


def _stirling(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0: shifted by 8, then Stirling's series (error below 1e-13)."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * np.pi) + series - shift


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    return _stirling(n + 0.5)


def _lgamma_one(n: np.ndarray) -> np.ndarray:
    return _stirling(n + 1.0)


def decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(8, bytes) arrays: the decision nodes (1 to 255) on the way to each byte, and the bits taken."""
    shift = np.arange(8)[:, None]
    return (1 << shift) | (byte >> (8 - shift)), (byte >> (7 - shift)) & 1


class Level:
    """All contexts of one depth in a subtree: ids of contexts and, per (context, node), counts, weights and estimates."""

    def __init__(self, context: np.ndarray, byte: np.ndarray, count: np.ndarray):
        self.contexts = np.unique(context)
        at = np.searchsorted(self.contexts, context)
        node, bit = decisions(byte)
        entry = ((at[None, :] << 8) | node).ravel()
        self.entries, where = np.unique(entry, return_inverse=True)
        n = np.bincount(where * 2 + bit.ravel(), np.broadcast_to(count, node.shape).ravel(), 2 * len(self.entries)).reshape(-1, 2)
        self.n0, self.n1 = n[:, 0], n[:, 1]
        self.own = kt_log(self.n0, self.n1)
        self.weighted = self.own

    def weigh(self, longer: np.ndarray) -> None:
        """longer: the sum of the log weighted probabilities of the contexts one byte longer, per entry."""
        self.weighted = np.logaddexp(HALF + self.own, HALF + longer)

    def stop(self) -> np.ndarray:
        return np.exp(np.minimum(0, HALF + self.own - self.weighted))

    def find(self, context: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, known) of (context, node); a known context's node may be unknown still."""
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        key = (at << 8) | node
        i = np.minimum(np.searchsorted(self.entries, key), len(self.entries) - 1)
        return i, (self.contexts[at] == context) & (self.entries[i] == key)


def subtree(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels 3 to DEPTH of whole contexts of three bytes, weighted from the leaves up. The deepest contexts stop for certain."""
    byte = keys & 255
    context = lambda d: keys >> (8 * (DEPTH - d + 1))
    levels = [Level(context(d), byte, counts) for d in range(3, DEPTH + 1)]
    for upper, lower in zip(levels[-2::-1], levels[:0:-1]):
        parent = (np.searchsorted(upper.contexts, lower.contexts >> 8)[lower.entries >> 8] << 8) | (lower.entries & 255)
        upper.weigh(np.bincount(np.searchsorted(upper.entries, parent), lower.weighted, len(upper.entries)))
    return levels


def descend(levels: list, keys: np.ndarray, given: np.ndarray, rest: np.ndarray, last: np.ndarray) -> np.ndarray:
    """log10 P(byte | context) of keys, from what Top.above() says of the shallower contexts.

    Each level, from that of two bytes on, adds rest * stop * its estimate and leaves rest * (1 - stop); what the last seen
    context leaves goes to its own estimate.
    """
    node, bit = decisions(keys & 255)
    given, rest = given.copy(), rest.copy()
    for d, level in enumerate(levels, 2):
        if level is None:
            continue
        i, known = level.find(np.broadcast_to(keys >> (8 * (DEPTH - d + 1)), node.shape).ravel(), node.ravel())
        i, known = i.reshape(node.shape), known.reshape(node.shape)
        estimate = (np.where(bit == 1, level.n1[i], level.n0[i]) + 0.5) / (level.n0[i] + level.n1[i] + 1)
        stop = 1.0 if d == DEPTH else level.stop()[i]
        given += np.where(known, rest * stop * estimate, 0)
        last = np.where(known, estimate, last)
        rest = np.where(known, rest * (1 - stop), rest)
    return np.log10(given + rest * last).sum(0)


class Pairs(Level):
    """The contexts of two bytes that a bucket needs, from their table: entry is 256 * context + node."""

    def __init__(self, entry: np.ndarray, n0: np.ndarray, n1: np.ndarray, longer: np.ndarray):
        order = np.argsort(entry, kind="stable")
        entry, self.n0, self.n1 = entry[order], n0[order], n1[order]
        self.contexts, at = np.unique(entry >> 8, return_inverse=True)
        self.entries = (at << 8) | (entry & 255)
        self.own = kt_log(self.n0, self.n1)
        self.weigh(longer[order])


class Top:
    """The contexts of no and one byte: 255 and 255 * 256 decision nodes."""

    def __init__(self, rows: list[tuple[int, int, float, float, float]]):
        """rows: (last byte, node, n0, n1, sum of the log weighted probabilities of the two-byte contexts)."""
        self.n = np.zeros((256, 256, 2))
        longer = np.zeros((256, 256))
        for c, node, n0, n1, w in rows:
            self.n[c, node] = n0, n1
            longer[c, node] = w
        own = kt_log(self.n[..., 0], self.n[..., 1])
        weighted = np.logaddexp(HALF + own, HALF + longer)
        self.stop1 = np.exp(np.minimum(0, HALF + own - weighted))
        self.n_all = self.n.sum(0)
        own0 = kt_log(self.n_all[:, 0], self.n_all[:, 1])
        self.stop0 = np.exp(np.minimum(0, HALF + own0 - np.logaddexp(HALF + own0, HALF + weighted.sum(0))))

    def above(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(8, keys) arrays per decision: the part of the mixture that these contexts give, the weight they leave to longer
        contexts, and the estimate of the longest of them that was seen, to which the weight goes if no longer one was."""
        node, bit = decisions(keys & 255)
        c = keys >> (8 * DEPTH)
        n0 = self.n_all[node]
        first = (np.take_along_axis(n0, bit[..., None], 2)[..., 0] + 0.5) / (n0.sum(2) + 1)
        n1 = self.n[c[None, :], node]
        seen = n1.sum(2) > 0
        second = (np.take_along_axis(n1, bit[..., None], 2)[..., 0] + 0.5) / (n1.sum(2) + 1)
        stop0, stop1 = self.stop0[node], self.stop1[c[None, :], node]
        left = 1 - stop0
        given = stop0 * first + np.where(seen, left * stop1 * second, 0)
        rest = np.where(seen, left * (1 - stop1), left)
        return given, rest, np.where(seen, second, first)


# ---- the operator


def weighed(docs: DataFrame, rows_limit: float, chars_limit: float) -> tuple[DataFrame, bool]:
    """(doc_id, text, times) of docs (doc_id, text), and whether any row stands for several.

    Equal rows are one row with their number where that is over rows_limit or their characters are over chars_limit, so that
    no block holds many of them; others stay rows of their own. Candidates are told by hash, and counted by id and text.
    """
    key = F.xxhash64("doc_id", "text")
    counts = docs.groupBy(key.alias("h")).agg(F.count("*").alias("c"), F.max(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    often = materialize(counts.where((F.col("c") > 1) & ((F.col("c") > rows_limit) | (F.col("c") * F.col("chars") > chars_limit))).select("h"))
    if often.isEmpty():
        return docs.withColumn("times", F.lit(1).cast("long")), False
    hashed = docs.withColumn("h", key)
    once = hashed.join(often, "h", "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("times"))
    several = materialize(hashed.join(often, "h", "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("times")))
    return once.unionByName(several), True


def packed_texts(placed: DataFrame) -> DataFrame:
    """(block, ids, held, times, sizes, texts) of placed (doc_id, held_out, text, block, times): several documents of a block a
    row, their texts compressed together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            columns = []
            for rows in held.values():
                ids, out, raws, times = zip(*rows)
                columns.append((ids, out, times, list(map(len, raws)), pa.compress(b"".join(raws), codec="zstd", asbytes=True)))
            types = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*columns), types))], ["block", "ids", "held", "times", "sizes", "texts"])
            held.clear()
            return batch

        for batch in batches:
            ids, out, blocks, times = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i, o, text, block, n in zip(ids, out, batch.column(2), blocks, times):
                raw = text.as_py().encode()
                held.setdefault(block, []).append((i, o, raw, n))
                size += len(raw)
                if size > PACKED:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return placed.select("doc_id", "held_out", "text", "block", "times").mapInArrow(pack, "block int, ids array<long>, held array<boolean>, times array<long>, sizes array<int>, texts binary")


def unpacked(sizes: list[int], blob: bytes) -> Iterator[bytes]:
    raw, at = pa.decompress(blob, sum(sizes), codec="zstd", asbytes=True), 0
    for size in sizes:
        yield raw[at : at + size]
        at += size


LISTS = "bucket int, part int, n int, keys binary, counts binary"


def block_lists(packed: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """(bucket, part, n, keys, counts): the distinct keys of each block, which is the part, by bucket, with their counts in
    training, 0 for keys of held-out texts alone."""

    def lists(block: int, held: dict[tuple[bool, bool], Gathered]) -> Iterator[pa.RecordBatch]:
        for words in (False, True):
            both = [held.pop((words, out), Gathered()) for out in (False, True)]
            for g in both:
                g.merge()
            keys, counts = merged([g.keys for g in both], [both[0].counts, np.zeros(len(both[1].keys), np.int64)])
            bucket = buckets_of(keys, words, buckets)
            order = np.argsort(bucket, kind="stable")
            keys, counts, bucket = keys[order], counts[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.empty(0, int)
            rows = [(int(bucket[a]), block, z - a, key_list(keys[a:z]), squeezed(counts[a:z])) for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)])]
            yield list_rows(rows)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bool, bool], Gathered] = {}
        current = None
        for batch in batches:
            for block, outs, times, sizes, blob in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if block != current and current is not None:
                    yield from lists(current, held)
                current = block
                for out, n, raw in zip(outs, times, unpacked(sizes, blob)):
                    words = raw.lower().split()
                    held.setdefault((False, out), Gathered()).add(grams(closed(words)), n)
                    held.setdefault((True, out), Gathered()).add(word_keys(words), n)
        if current is not None:
            yield from lists(current, held)

    return packed.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(gather, LISTS)


def list_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], ["bucket", "part", "n", "keys", "counts"])


def merged_lists(lists: DataFrame, parts: int) -> DataFrame:
    """One list a bucket: at most MERGED_BLOCKS lists are merged at once, in as many rounds as it takes."""

    def merge(rows: pa.Table) -> pa.Table:
        read = [rows[c].to_pylist() for c in ("keys", "counts", "n")]
        keys, counts = merged([listed_keys(k, n) for k, n in zip(read[0], read[2])], [unsqueezed(c, n) for c, n in zip(read[1], read[2])])
        return pa.Table.from_batches([list_rows([(rows["bucket"][0].as_py(), rows["part"][0].as_py() // MERGED_BLOCKS, len(keys), key_list(keys), squeezed(counts))])])

    while True:
        lists = lists.groupBy("bucket", F.floor(F.col("part") / MERGED_BLOCKS)).applyInArrow(lambda rows: merge(rows), LISTS)
        parts = ceil(parts / MERGED_BLOCKS)
        if parts <= 1:
            return lists


def pair_roots(model: DataFrame) -> DataFrame:
    """(entry, n0, n1, longer) per decision of each context of two bytes: counts, and the sum of the log weighted probabilities
    of its longer contexts."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, blob, counted in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys, counts = listed_keys(blob, n), unsqueezed(counted, n)
                keys, counts = keys[counts > 0], counts[counts > 0]
                for a, z in segments(keys):
                    level = subtree(keys[a:z], counts[a:z])[0]
                    entry, where = np.unique(((level.contexts[level.entries >> 8] >> 8) << 8) | (level.entries & 255), return_inverse=True)
                    sums = [np.bincount(where, x, len(entry)) for x in (level.n0, level.n1, level.weighted)]
                    yield pa.RecordBatch.from_arrays([pa.array(entry), *map(pa.array, sums)], ["entry", "n0", "n1", "longer"])

    found = model.select("n", "keys", "counts").mapInArrow(roots, "entry long, n0 double, n1 double, longer double")
    return found.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "longer")])


def top_of(pairs: DataFrame) -> Top:
    """What lies above the contexts of two bytes: at most 256 * 255 rows come to the driver, whatever the corpus."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, n0, n1, longer = (c.to_numpy() for c in batch.columns)
            level = Pairs(entry, n0, n1, longer)
            order = np.argsort(entry, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array(((entry >> 16) << 8 | entry & 255)[order]), pa.array(level.n0), pa.array(level.n1), pa.array(level.weighted)], ["entry", "n0", "n1", "w"])

    summed = pairs.mapInArrow(weigh, "entry long, n0 double, n1 double, w double").groupBy("entry").agg(F.sum("n0"), F.sum("n1"), F.sum("w"))
    return Top([(r[0] >> 8, r[0] & 255, r[1], r[2], r[3]) for r in summed.collect()])


def score(docs: DataFrame, folds: int = 10, held_out_fold: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one row per input row.

    Learned from the rows whose crc32(doc_id as text) mod folds is not held_out_fold (a null id counts as remainder 1).
    A text (null: empty) is its words, each closed by a blank, and an end; score is the log10 of the tree's probability of
    that byte string, base_score that of the smoothed word frequencies. Words are told apart by 64-bit hashes. Without any
    training token the tree gives each byte 2^-8. Rows keep their number; other columns are ignored.
    """
    spark = docs.sparkSession
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(1))
    sized = docs.select("doc_id", "text")
    chars, rows = sized.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(1, ceil(chars / block_chars), ceil(rows / BLOCK_ROWS))
    buckets = min(1 << 20, max(64, ceil(sqrt(chars) / 80)))  # distinct grams grow more slowly than the text
    weighted, repeated = weighed(sized, BLOCK_ROWS / REPEATED, block_chars / REPEATED)
    placed = weighted.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == held_out_fold).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"), hashed_block(F.struct("doc_id", "text"), blocks).alias("block"), "times")
    packed = packed_texts(placed)

    lists = materialize(block_lists(packed, blocks, buckets))
    model = materialize(merged_lists(lists, blocks))
    words = model.where(F.col("bucket") >= buckets).mapInArrow(_totals, "n long, known long")
    train_tokens, distinct = (x or 0 for x in words.agg(F.sum("n"), F.sum("known")).first())
    pairs = materialize(pair_roots(model.where(F.col("bucket") < buckets)))
    top = spark.sparkContext.broadcast(top_of(pairs))
    answered = answers(lists, model, pairs, top, buckets)

    def sums(texts: pa.Table, found: pa.Table) -> pa.Table:
        """Scores of a block's documents: the block's distinct keys, found anew, are in the order of the answers."""
        by = dict(zip(found["bucket"].to_pylist(), found["answer"].to_pylist()))

        def values_of(keys: np.ndarray, is_words: bool) -> np.ndarray:
            bucket = buckets_of(keys, is_words, buckets)
            out = np.empty(len(keys))
            out[np.argsort(bucket, kind="stable")] = np.concatenate([np.frombuffer(by[b], "<f8") for b in np.unique(bucket).tolist()])
            return out

        ids, outs, times, raws, keys = [], [], [], [], []
        for i, o, n, sizes, blob in zip(*(texts[c].to_pylist() for c in ("ids", "held", "times", "sizes", "texts"))):
            ids += i
            outs += o
            times += n
            for raw in unpacked(sizes, blob):
                listed = raw.lower().split()
                raws.append(closed(listed))
                keys.append(word_keys(listed))
        distinct_words, where = np.unique(np.concatenate(keys), return_inverse=True)
        n = list(map(len, keys))
        begins = np.cumsum([0, *n[:-1]])
        count = values_of(distinct_words, True)
        known = np.add.reduceat((count > 0).astype(np.int64)[where], begins)
        base = np.add.reduceat(np.log10((count + 0.1) / (train_tokens + 0.1 * (distinct + 1)))[where], begins)
        own = _sums(raws, lambda keys: values_of(keys, False))
        bits = [-x / log(2, 10) / (len(r) - DEPTH) for x, r in zip(own, raws)]
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        names = ["doc_id", "held_out", "times", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"]
        return pa.table([pa.array(c, t) for c, t in zip((ids, outs, times, n, known, base, own, bits), types)], names)

    schema = "doc_id long, held_out boolean, times long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
    scored = packed.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(sums, schema)
    if repeated:
        # As many rows again as there were, in two steps so that no task lists all rows of one text.
        scored = scored.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / EXPANDED)))).repartition(F.col("run"), F.col("doc_id"), F.col("score"))
        scored = scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(EXPANDED).cast("long"), F.col("times") - F.col("run") * EXPANDED))))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [unsqueezed(c, n) for c, n in zip(batch.column(4).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([int((c > 0).sum()) for c in counts], pa.int64())], ["n", "known"])


def answers(lists: DataFrame, model: DataFrame, pairs: DataFrame, top: Broadcast, buckets: int) -> DataFrame:
    """(block, bucket, answer): for the keys of each block's list the log10 probabilities of grams, or the counts of words.

    A bucket's lists, its part of the model and the contexts of two bytes above it meet in one task; where the lists come to
    more than ASKED_BYTES they are cut into parts, each with its own copy of what is smaller than they are.
    """
    size = lists.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("keys")) / ASKED_BYTES).cast("int").alias("turns"))
    turns = F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn")
    entries = pairs.select("entry", *[F.struct("entry", "n0", "n1", "longer").alias("pair")])
    by_pair = entries.groupBy(F.shiftright("entry", 8).alias("pair_no")).agg(F.collect_list("pair").alias("pairs"))  # at most 255

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, n, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                found = np.unique(listed_keys(blob, n) >> (8 * (DEPTH - 1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), bucket, np.int32)), pa.array(found)], ["bucket", "pair_no"])

    above = model.where(F.col("bucket") < buckets).select("bucket", "n", "keys").mapInArrow(needed, "bucket int, pair_no long").join(by_pair, "pair_no")
    none = F.lit(None)
    columns = ["bucket", "turn", "kind", "block", "n", "keys", "counts", "pairs"]
    no_pairs = none.cast("array<struct<entry:bigint,n0:double,n1:double,longer:double>>").alias("pairs")
    given = [
        model.join(size, "bucket").select("bucket", turns, F.lit(0).alias("kind"), none.cast("int").alias("block"), "n", "keys", "counts", no_pairs),
        above.join(size, "bucket").select("bucket", turns, F.lit(1).alias("kind"), none.cast("int").alias("block"), none.cast("int").alias("n"), none.cast("binary").alias("keys"), none.cast("binary").alias("counts"), "pairs"),
        lists.join(size, "bucket").select("bucket", F.pmod("part", "turns").cast("int").alias("turn"), F.lit(2).alias("kind"), F.col("part").alias("block"), "n", "keys", none.cast("binary").alias("counts"), no_pairs),
    ]
    met = given[0].unionByName(given[1]).unionByName(given[2]).select(*columns)

    def answer(rows: pa.Table) -> pa.Table:
        kind, bucket = rows["kind"].to_numpy(), rows["bucket"][0].as_py()
        of = lambda k: rows.filter(pa.array(kind == k))
        own = of(0).to_pylist()[0]
        keys, counts = listed_keys(own["keys"], own["n"]), unsqueezed(own["counts"], own["n"])
        if bucket >= buckets:
            value = counts.astype("<f8")
        else:
            read = [x for row in of(1)["pairs"].to_pylist() for x in row]
            two = Pairs(*(np.array([x[c] for x in read]) for c in ("entry", "n0", "n1", "longer"))) if read else None
            value = np.empty(len(keys))
            for a, z in segments(keys):
                part, n = keys[a:z], counts[a:z]
                levels = [two, *(subtree(part[n > 0], n[n > 0]) if n.any() else [])]
                for s in range(a, z, 20_000):
                    some = keys[s : min(z, s + 20_000)]
                    value[s : s + len(some)] = descend(levels, some, *top.value.above(some))
        asked = of(2)
        out = [value[np.searchsorted(keys, listed_keys(b, n))].tobytes() for b, n in zip(asked["keys"].to_pylist(), asked["n"].to_pylist())]
        return pa.table([asked["block"].cast(pa.int32()), pa.array([bucket] * len(out), pa.int32()), pa.array(out, pa.binary())], ["block", "bucket", "answer"])

    return met.groupBy("bucket", "turn").applyInArrow(answer, "block int, bucket int, answer binary")


def document_sums(raws: list[bytes], value: np.ndarray) -> np.ndarray:
    """Of each text the sum over its grams of value, which belongs to the sorted distinct grams of all of them."""
    return _sums(raws, lambda keys: value)


def _sums(raws: list[bytes], values_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Of each text the sum over its grams of their values; values_of is asked once, for the sorted distinct grams of all.

    A gram leaves the bits of a text number free, so one sort brings equal grams together without losing whose they are.
    """
    spare = 63 - 8 * (DEPTH + 1)
    out = np.zeros(len(raws))
    sizes = [len(r) - DEPTH for r in raws]
    if len(raws) > 1 << spare:
        runs = [raws[a : a + (1 << spare)] for a in range(0, len(raws), 1 << spare)]
        known = np.unique(np.concatenate([np.unique(np.concatenate([grams(r) for r in run])) for run in runs]))
        value = values_of(known)
        return np.concatenate([_sums(run, lambda keys: value[np.searchsorted(known, keys)]) for run in runs])
    every, at = np.empty(sum(sizes), np.int64), 0
    for i, (raw, size) in enumerate(zip(raws, sizes)):
        every[at : at + size] = (grams(raw) << spare) | i
        at += size
    every.sort()
    slices = [every[a : a + (1 << 20)] for a in range(0, len(every), 1 << 20)]
    known, last = [], -1
    for part in slices:
        key = part >> spare
        known.append(key[np.append(key[0] != last, key[1:] != key[:-1])])
        last = key[-1]
    value = values_of(np.concatenate(known))
    seen, last = -1, -1
    for part in slices:
        key = part >> spare
        rank = np.cumsum(np.append(key[0] != last, key[1:] != key[:-1])) + seen
        out += np.bincount(part & ((1 << spare) - 1), value[rank], len(raws))
        seen, last = int(rank[-1]), key[-1]
    return out
