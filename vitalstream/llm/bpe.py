"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be merged over, so the text is cut
there and the fragments are encoded on their own. The vocabulary file (a few MB, its size is checked) is read by the driver
and broadcast; Spark spreads the texts over tasks, each of which keeps a bounded table of fragments it has met.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces

#: Fixed by the vocabulary's pre-tokenizer: the split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without the characters of UNUSUAL, where letters and digits can be listed and a faster engine serves.
PLAIN_SPLIT = r" ?[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u024F]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\sA-Za-z0-9\xC0-\xD6\xD8-\xF6\xF8-\u024F]+|\s+(?!\S)|\s+"
UNUSUAL = r"[^\t\n\r\x20-\x7E\xC0-\xD6\xD8-\xF6\xF8-\u024F\u2010-\u2027]"
MAX_VOCABULARY_BYTES = 64 << 20
#: Entries of a task's table of fragments; beyond, it starts anew.
MEMO = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder of one vocabulary file in the tokenizers format."""

    def __init__(self, model_json: bytes):
        import regex

        spec = json.loads(model_json)
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(of_letter[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self.decimal = [str(i) for i in range(size)]
        self.byte_id = [vocab[c] for c in letters]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.rank_of = self.ranks.get
        self.made = [vocab[a + b] for a, b in merges]
        self.joined = {pair for token in self.token_bytes for pair in zip(token, token[1:])}
        self.any_words, self.plain_words, self.unusual = regex.compile(SPLIT).findall, re.compile(PLAIN_SPLIT).findall, re.compile(UNUSUAL).search
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.memo: dict[str, tuple[int, ...]] = {}

    def fragments(self, raw: bytes) -> Iterator[bytes]:
        """raw, cut wherever no token of the vocabulary holds the two bytes side by side."""
        start = 0
        for i in range(1, len(raw)):
            if (raw[i - 1], raw[i]) not in self.joined:
                yield raw[start:i]
                start = i
        yield raw[start:]

    def fragment_ids(self, raw: bytes) -> list[int]:
        """Merge the lowest-ranked pair, leftmost first, until none is left; long fragments by a heap instead of rescanning."""
        ids, rank_of, none = [self.byte_id[b] for b in raw], self.rank_of, len(self.made)
        if len(ids) > 256:
            return self._long_fragment_ids(ids)
        ranks = [rank_of(p, none) for p in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) != none:
            i = ranks.index(rank)
            ids[i] = new = self.made[rank]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], new), none)
            if i < len(ranks):
                ranks[i] = rank_of((new, ids[i + 1]), none)
        return ids

    def _long_fragment_ids(self, ids: list[int]) -> list[int]:
        ranks, n = self.ranks, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) < 0 or ranks.get((ids[i], ids[j])) != rank:
                continue
            ids[i], alive[j] = (new := self.made[rank]), False
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (found := ranks.get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (found, i))
            if (h := before[i]) >= 0 and (found := ranks.get((ids[h], new))) is not None:
                heapq.heappush(heap, (found, h))
        return [x for x, live in zip(ids, alive) if live]

    def _word(self, word: str) -> tuple[int, ...]:
        found = tuple(chain.from_iterable(map(self.fragment_ids, self.fragments(word.encode()))))
        if len(word) <= 64:
            self.memo[word] = found
        return found

    def words(self, text: str) -> list[str]:
        return (self.any_words if self.unusual(text) else self.plain_words)(text)

    def encode(self, text: str) -> list[int]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        pieces = self.cut_special(text) if self.cut_special and any(s in text for s in self.special) else [text]
        out: list[int] = []
        known, word = self.memo.get, self._word
        for piece in pieces:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                words = self.words(piece)
                out.extend(chain.from_iterable([known(w) or word(w) for w in words]))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", errors="replace")

    def digests(self, ids: list[int]) -> tuple[str, str]:
        """SHA-256 of the decimal ids joined by commas, and of the decoded text."""
        listed = ",".join(map(self.decimal.__getitem__, ids))
        return hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode("utf-8")).hexdigest()


_loaded: dict[bytes, ForcedBoundaryBPE] = {}


def _encoder(model_json: bytes) -> ForcedBoundaryBPE:
    """One encoder per Python worker, kept from task to task."""
    key = hashlib.sha256(model_json).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ForcedBoundaryBPE(model_json)
    return _loaded[key]


def read_vocabulary(path: str) -> bytes:
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes, the bound of what is broadcast")
    with open(path, "rb") as f:
        return f.read()


def encode(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """docs' doc_id and text with ids, an array of the token ids. A null text has no ids, nor has ''; rows keep their number."""
    model = spark.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(model.value)
        for batch in (piece for whole in batches for piece in pieces(whole, 1)):
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "text", "ids"])
        bpe.memo.clear()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(spark: SparkSession, encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) with text, decoded; bytes that form no UTF-8 become U+FFFD. Null ids give ''."""
    model = spark.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(model.value)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(spark: SparkSession, docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of docs: encode, then decode, in one pass over the texts.

    with_ids adds ids, the array of token ids. Null and empty texts have no tokens and the digests of ''. Equal rows give
    equal results. Other columns are ignored.
    """
    model = spark.sparkContext.broadcast(read_vocabulary(path))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(model.value)
        for batch in (piece for whole in batches for piece in pieces(whole, 1)):
            n, listed, decoded, every = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                a, b = bpe.digests(ids)
                n.append(len(ids))
                listed.append(a)
                decoded.append(b)
                if with_ids:
                    every.append(array("i", ids))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                offsets = pa.array(list(accumulate(n, initial=0)), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(map(bytes, every)), np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)
        bpe.memo.clear()  # the worker goes on to tasks of other operators

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
