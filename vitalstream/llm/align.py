"""Alignment of two tokenizers' tokens: where both end a token at the same byte, and which ids meet there how often.

Inside a task everything is an Arrow column: the token lists are flattened with the index of their parent, byte lengths are
summed up within each document, and an Acero hash join on (document, end) finds the ends that both have. A chunk of
documents lists its distinct id pairs with their counts (Table.group_by), Spark adds these partial counts up, and each chunk
gets the totals of its own pairs back, so no task holds the counts of all pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import SPLIT, byte_letters, read_vocabulary
from .common import materialize

#: Bytes of text that are held as tokens at a time.
CHUNK_BYTES = 2 << 20
#: White space beyond ASCII, and the mark that a piece has for a blank.
OTHER_BLANKS = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x2581]))
#: Texts in which not each blank and line end stands alone between other characters; they are encoded whole. In the others no
#: token of either vocabulary spans the place before a blank or line end, so a chunk's distinct pieces are encoded once.
UNEVEN = re.compile(rf"[ \n][ \n]|\A[ \n]|[ \n]\Z|[\t\x0b-\r\x1c-\x1f{OTHER_BLANKS}]").search


class Tokenizers:
    """Both vocabularies: ids of texts, and the bytes of each id. A is a tokenizers file, B a sentencepiece model."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        import tiktoken

        of_letter = {c: b for b, c in enumerate(byte_letters())}
        vocab = json.loads(a_json)["model"]["vocab"]
        added = {t["content"] for t in json.loads(a_json)["added_tokens"]}
        ranks = {bytes(of_letter[c] for c in token): i for token, i in vocab.items() if token not in added}
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        a_bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            a_bytes[i] = raw
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        decimals = [[f"{i}{end}" for i in range(len(x))] for x, ends in ((a_bytes, ",|"), (b_bytes, ",;")) for end in ends]
        self.starts = [*accumulate(map(len, decimals), initial=0)]
        self.decimals = pa.array([x for part in decimals for x in part], pa.large_string())

    def ids(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The token ids of both, a list for each text (space + text for A; B adds the space itself)."""
        even = pa.array([not UNEVEN(t) for t in texts.to_pylist()], pa.bool_())
        cut = pc.split_pattern(pc.replace_substring(texts.filter(even), "\n", " \n"), " ")
        pieces = pc.list_flatten(cut).dictionary_encode()
        own = pieces.dictionary.to_pylist()
        a = [self.a.encode_ordinary(x if x[0] == "\n" else " " + x) for x in own]
        # A piece that begins with a line end has no blank before it: the one that B adds is taken off.
        b = [ids[1:] if x[0] == "\n" else ids for x, ids in zip(own, self.b.encode(own, num_threads=1))]
        whole = texts.filter(pc.invert(even)).to_pylist()
        order = pa.array(np.argsort(np.concatenate([np.flatnonzero(even), np.flatnonzero(pc.invert(even))]), kind="stable"))
        sides = []
        for known, rest in ((a, [self.a.encode_ordinary(" " + t) for t in whole]), (b, self.b.encode(whole, num_threads=1))):
            lists = pa.array(known, pa.list_(pa.int32())).take(pieces.indices)
            offsets = lists.offsets.take(cut.offsets)
            joined = pa.ListArray.from_arrays(offsets, lists.values)
            sides.append(pa.concat_arrays([joined, pa.array(rest, pa.list_(pa.int32()))]).take(order))
        return sides[0], sides[1]


def _ends(ids: pa.Array, token_bytes: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """(flat ids, (document, end) keys, their bytes, byte totals of the documents) of token lists."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids).cast(pa.int64())
    raw = token_bytes.take(flat)
    sums = np.append(0, pc.cumulative_sum(pc.binary_length(raw).cast(pa.int64())).to_numpy())
    tokens = np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy()))
    base = sums[tokens]  # the bytes before each document
    end = pc.subtract(pa.array(sums[1:]), pa.array(base).take(parent))
    key = pc.add(pc.shift_left(parent, pa.scalar(36, pa.int64())), end)
    return flat, key, raw, np.diff(base)


def _bytes_of(values: pa.Array) -> memoryview:
    """The bytes of a freshly made string or binary array, side by side."""
    whole = values.buffers()[2]
    return memoryview(b"") if whole is None else memoryview(whole).cast("B")


class Aligned:
    """The aligned tokens of a chunk of texts. valid: the texts whose tokens' bytes are those of space + text; only they have
    tokens here. Tokens of all of them stand in one column a side, a_starts and b_starts are their first ones."""

    def __init__(self, texts: pa.Array, both: Tokenizers):
        given = pc.fill_null(texts, "")
        full = np.flatnonzero(pc.not_equal(given, "").to_numpy(zero_copy_only=False))
        given = given.take(pa.array(full))
        ids = both.ids(given)
        wanted = [b" " + t.encode("utf-8", "surrogatepass") for t in given.to_pylist()]
        fits = np.ones(len(full), bool)
        for side, token_bytes in zip(ids, (both.a_bytes, both.b_bytes)):
            _, _, raw, totals = _ends(side, token_bytes)
            there, at = _bytes_of(raw), np.append(0, np.cumsum(totals))
            fits &= np.array([there[at[i] : at[i + 1]] == w for i, w in enumerate(wanted)], bool)
        keep = pa.array(np.flatnonzero(fits))
        self.valid = full[fits]
        a_ids, b_ids = (side.take(keep) for side in ids)
        self.a, a_key, _, _ = _ends(a_ids, both.a_bytes)
        self.b, b_key, _, _ = _ends(b_ids, both.b_bytes)
        self.n_a, self.n_b = (pc.list_value_length(x).to_numpy().astype(np.int64) for x in (a_ids, b_ids))
        left = pa.table({"end": a_key, "i": pa.array(np.arange(len(self.a)))})
        right = pa.table({"end": b_key, "j": pa.array(np.arange(len(self.b)))})
        met = left.join(right, "end", join_type="inner", use_threads=False)
        order = np.argsort(met["i"].to_numpy(), kind="stable")
        self.end = met["end"].to_numpy()[order]
        self.i, self.j = met["i"].to_numpy()[order], met["j"].to_numpy()[order]  # no token is empty, so ends are unique
        self.link_text = (self.end >> 36).astype(np.int64)
        self.n_links = np.bincount(self.link_text, minlength=len(self.valid)).astype(np.int64)
        self.both = both

    def pairs(self) -> pa.Table:
        """(text, pair, count_all): how many of a text's links hold A's id and B's, as one number; the texts in order."""
        a, b = (pc.cast(x.take(pa.array(at)), pa.int64()) for x, at in ((self.a, self.i), (self.b, self.j)))
        pair = pc.add(pc.shift_left(a, pa.scalar(32, pa.int64())), b)
        counted = pa.table({"text": self.link_text, "pair": pair}).group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")])
        return counted.take(pa.array(np.argsort(counted["text"].to_numpy(), kind="stable")))

    def listed(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each valid text as SHA-256."""
        last_a, last_b = (np.zeros(len(x), np.int64) for x in (self.a, self.b))
        last_a[self.i], last_b[self.j] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        starts = np.array(self.both.starts)
        b_before = np.append(0, self.j[:-1] + 1)  # of each group
        codes[np.arange(len(self.a)) + b_before[group_a]] = self.a.to_numpy() + starts[last_a]
        codes[np.arange(len(self.b)) + self.i[group_b] + 1] = self.b.to_numpy() + starts[2 + last_b]
        text = self.both.decimals.take(pa.array(codes))
        at = np.frombuffer(text.buffers()[1], np.int64)[: len(codes) + 1]
        cuts = at[np.append(0, np.cumsum(self.n_a + self.n_b))]
        whole = _bytes_of(text)
        return [hashlib.sha256(whole[s : e - 1]).hexdigest() for s, e in zip(cuts[:-1], cuts[1:])]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts of about `most` bytes; a longer text is a run of its own."""
    held, start = 0, 0
    for at, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if at > start and held + size > most:
            yield start, at
            held, start = 0, at
        held += size
    if start < len(texts):
        yield start, len(texts)


_loaded: dict[tuple[bytes, bytes], Tokenizers] = {}


def _tokenizers(a: bytes, b: bytes) -> Tokenizers:
    """One pair per Python worker, kept from task to task."""
    key = hashlib.sha256(a).digest(), hashlib.sha256(b).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizers(a, b)
    return _loaded[key]


def _models(spark: SparkSession, a_path: str, b_path: str):
    return spark.sparkContext.broadcast((read_vocabulary(a_path), read_vocabulary(b_path)))


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, group_no, end, a_ids, b_ids): the tokens between two common ends, and the byte offset in space + text at which
    the group ends, of every text that has tokens. In order within a document."""
    models = _models(docs.sparkSession, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(*models.value)
        for batch in batches:
            for start, stop in chunks(batch.column(1)):
                x = Aligned(batch.column(1).slice(start, stop - start), both)
                no = np.arange(len(x.i)) - np.repeat(np.cumsum(x.n_links) - x.n_links, x.n_links)
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, at + 1), pa.int32()), ids) for at, ids in ((x.i, x.a), (x.j, x.b))]
                ids = batch.column(0).take(pa.array(start + x.valid[x.link_text]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(no), pa.array(x.end & ((1 << 36) - 1)), *lists], ["doc_id", "group_no", "end", "a_ids", "b_ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, group_no long, end long, a_ids array<int>, b_ids array<int>")


_FACTS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>, times array<int>, pair array<long>, n array<int>"


def _facts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of two kinds: one per document with the pairs that its links hold, as numbers of its chunk's pairs, and how often, and
    one per chunk with its distinct pairs and their counts, the most frequent first. A chunk is a batch of a task."""
    models = _models(docs.sparkSession, a_path, b_path)
    names = [x.split()[0] for x in _FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, no = _tokenizers(*models.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            if not (rows := len(batch)):
                continue
            n_a, n_b, n_links, n_pairs = (np.zeros(rows, np.int64) for _ in range(4))
            digests, pairs = [""] * rows, []
            for start, stop in chunks(batch.column(1)):
                x = Aligned(batch.column(1).slice(start, stop - start), both)
                at = start + x.valid
                n_a[at], n_b[at], n_links[at] = x.n_a, x.n_b, x.n_links
                for i, digest in zip(at.tolist(), x.listed()):
                    digests[i] = digest
                pairs.append(x.pairs())
                n_pairs[at] = np.bincount(pairs[-1]["text"].to_numpy(), minlength=len(at))
            found = pa.concat_tables(pairs)
            counted = found.group_by("pair", use_threads=False).aggregate([("count_all", "sum")]).rename_columns(["pair", "n"]).sort_by([("n", "descending"), ("pair", "ascending")])
            numbers = pc.index_in(found["pair"], value_set=counted["pair"].combine_chunks())
            cuts = pa.array(np.append(0, np.cumsum(n_pairs)), pa.int32())
            links, times = (pa.ListArray.from_arrays(cuts, x.combine_chunks().cast(pa.int32())) for x in (numbers, found["count_all"]))
            here = pa.array(np.full(rows, no), pa.int64())
            own = [here, batch.column(0), *map(pa.array, (n_a, n_b, n_links)), pa.array(digests, pa.string()), links, times, pa.nulls(rows, pa.list_(pa.int64())), pa.nulls(rows, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(own, names)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(counted)], pa.int32()), counted[c].combine_chunks().cast(k)) for c, k in (("pair", pa.int64()), ("n", pa.int32()))]
            nothing = [pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([here[:1], *nothing, *lists], names)
            no += 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FACTS)


def _listed_pairs(facts: DataFrame) -> DataFrame:
    """(chunk, no, pair, n) of the chunks' lists."""
    rows = facts.where("pair is not null").select("chunk", F.posexplode(F.arrays_zip("pair", "n")).alias("no", "x"))
    return rows.select("chunk", "no", "x.pair", F.col("x.n").cast("long").alias("n"))


def _totals(listed: DataFrame) -> DataFrame:
    """(pair, total, best): how many links hold the pair, and whether no pair of its B id has more."""
    total = listed.groupBy("pair").agg(F.sum("n").alias("total"))
    most = F.max("total").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))
    return total.select("pair", "total", (F.col("total") == most).alias("best"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a_id, b_id, n, best) of every id pair that a link holds."""
    totals = _totals(_listed_pairs(_facts(docs, a_path, b_path)))
    return totals.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), F.col("total").alias("n"), "best")


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of docs (doc_id, text).

    Texts that are null or empty, and those whose tokens of one side do not spell space + text, have zeros and ''. Tokens are
    never empty, so each group ends in exactly one link. Each row counts, repeated ones and those without an id too. Other
    columns are ignored. An empty table gives an empty result.
    """
    facts = materialize(_facts(docs, a_path, b_path))
    listed = _listed_pairs(facts)
    told = listed.select("chunk", "no", "pair").join(_totals(listed), "pair").select(F.col("chunk").alias("of_chunk"), "no", "total", "best")
    own = facts.where("pair is null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "times")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        total, best = np.zeros(len(right) + 1, np.int64), np.zeros(len(right) + 1, np.int64)
        total[right["no"].to_numpy()], best[right["no"].to_numpy()] = right["total"].to_numpy(), right["best"].to_numpy()
        found = []
        for start in range(0, len(left), 1024):
            part = left.slice(start, 1024)
            cuts = np.append(0, np.cumsum(pc.list_value_length(part["links"]).to_numpy()))
            flat, times = (pc.list_flatten(part[c]).to_numpy() for c in ("links", "times"))
            found.append([np.diff(np.append(0, np.cumsum(values[flat] * times))[cuts]) for values in (best, total)])
        columns = [left[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")] + [pa.array(np.concatenate([f[k] for f in found] or [[]]).astype(np.int64)) for k in (0, 1)]
        return pa.table([*columns, left["groups_sha256"]], names)

    schema = ", ".join(f"{x} {'string' if x == 'groups_sha256' else 'long'}" for x in names)
    return own.groupBy("chunk").cogroup(told.groupBy("of_chunk")).applyInArrow(sums, schema)
