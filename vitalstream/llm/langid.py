"""Language ID: a byte convolutional network trained in numpy on labelled text.

Filters of several widths run over the bytes of fixed-length windows, are max-pooled over each window and go through a
softmax layer. Training takes a bounded sample (sample_per_label documents of each label, sample_docs of all,
windows_per_doc windows of each); prediction covers every window of every text. After training, a filter of width w is a sum of w table look-ups, so two
neighbouring bytes share one table of 65,536 rows and no byte needs a matrix product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import free_names, pieces

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
LETTER = re.compile(r"[^\W\d_]").search


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0))


def training_windows(docs: DataFrame, sample_per_label: int = 256, windows_per_doc: int = 4, sample_docs: int = 131_072) -> list[tuple[str, bytes]]:
    """(label, window) pairs of every label, at most sample_per_label * windows_per_doc of each, spread over each whole text.

    The sample has at most sample_docs documents: with more than sample_docs / sample_per_label labels each label gets an
    equal share of them, and one document at least.

    Of every label and each of sample_per_label hash slots, one row of least hash of (id, text) is taken: a partial
    aggregate, so a label with most of the rows costs nothing extra, and rows without an id or with a repeated one take
    slots by their texts. Of equal rows one is taken.
    """
    h = F.xxhash64("doc_id", "text")
    usable = docs.where("lang is not null and text is not null and length(text) > 0").select("doc_id", "lang", F.encode("text", "utf-8").alias("raw"), h.alias("h"))
    labels = usable.select("lang").distinct().count()
    sample_per_label = max(1, min(sample_per_label, sample_docs // max(1, labels)))
    slots = usable.groupBy(F.col("lang").alias("l"), F.pmod("h", F.lit(sample_per_label)).alias("slot")).agg(F.min("h").alias("least"))
    chosen = usable.join(slots, (F.col("lang") == F.col("l")) & (F.col("h") == F.col("least")))
    step = F.greatest(F.lit(0), F.octet_length("raw") - WINDOW) / F.lit(max(1, windows_per_doc - 1))
    windows = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(windows_per_doc - 1)), lambda i: F.substring(F.col("raw"), (F.floor(i * step) + 1).cast("int"), F.lit(WINDOW))))
    one = chosen.groupBy("lang", "slot").agg(F.min(F.struct("h", "doc_id", windows.alias("windows"))).alias("one"))
    rows = one.select("lang", "one.doc_id", "one.h", F.posexplode("one.windows").alias("n", "w")).orderBy("lang", "doc_id", "h", "n").collect()
    return [(r.lang, bytes(r.w)) for r in rows]


def padded(windows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(windows), WINDOW), np.uint8)
    for row, w in zip(out, windows):
        row[: len(w)] = np.frombuffer(w, np.uint8)
    return out


class ByteCNN:
    def __init__(self, labels: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED)), "d": np.zeros((len(WIDTHS) * FILTERS, len(labels))), "c": np.zeros(len(labels))}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["d"] += rng.normal(0, 0.1, self.p["d"].shape)

    def _step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, n = self.p, len(x)
        e = p["e"][x]
        pooled, at = [], []
        for w in WIDTHS:
            conv = sum(e[:, j : WINDOW - w + 1 + j] @ p[f"f{w}"][j] for j in range(w)) + p[f"b{w}"]
            best = conv.argmax(1)
            at.append(best)
            pooled.append(np.take_along_axis(conv, best[:, None], 1)[:, 0])
        z = np.concatenate(pooled, 1)
        h = np.maximum(z, 0)
        s = h @ p["d"] + p["c"]
        s = np.exp(s - s.max(1, keepdims=True))
        s /= s.sum(1, keepdims=True)
        loss = -np.log(s[np.arange(n), y] + 1e-12).mean()
        s[np.arange(n), y] -= 1
        s /= n
        g = {"d": h.T @ s, "c": s.sum(0), "e": np.zeros_like(p["e"])}
        dz = (s @ p["d"].T) * (z > 0)
        for i, w in enumerate(WIDTHS):
            d = dz[:, i * FILTERS : (i + 1) * FILTERS]
            seen = np.stack([np.take_along_axis(x, at[i] + j, 1) for j in range(w)], 2)  # window, filter, offset
            g[f"f{w}"] = np.einsum("nf,nfje->jef", d, p["e"][seen])
            g[f"b{w}"] = d.sum(0)
            np.add.at(g["e"], seen, np.einsum("nf,jef->nfje", d, p[f"f{w}"]))
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 5) -> ByteCNN:
        """Adam on minibatches that take each label equally often; beyond batch labels, as many more steps."""
        steps = max(steps, steps * len(self.labels) // batch)
        rng = np.random.default_rng(seed)
        own = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            i = np.array([rng.choice(own[k]) for k in rng.integers(0, len(own), batch)])
            _, g = self._step(x[i], y[i])
            now = rate * (0.1 if t > steps * 0.75 else 1)
            for k in g:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
                self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def ready(self) -> ByteCNN:
        """Build the look-up tables of prediction."""
        e = self.p["e"]
        one = {w: [(e @ self.p[f"f{w}"][j]).astype(np.float32) for j in range(w)] for w in WIDTHS}
        pair = lambda a, b: (a[:, None] + b[None, :]).reshape(65536, FILTERS)
        self.tables = {w: [(j, pair(one[w][j], one[w][j + 1])) if j + 1 < w else (j, one[w][j]) for j in range(0, w, 2)] for w in WIDTHS}
        return self

    def probabilities(self, x: np.ndarray, rows: int = 64) -> np.ndarray:
        """(windows, labels) of padded windows, a few windows at a time so that the working arrays stay in cache."""
        out = np.empty((len(x), len(self.labels)))
        for a in range(0, len(x), rows):
            b = x[a : a + rows].astype(np.intp)
            two = (b[:, :-1] << 8) | b[:, 1:]
            pooled = []
            for w in WIDTHS:
                n, conv = WINDOW - w + 1, None
                for j, t in self.tables[w]:
                    part = t.take((two if len(t) == 65536 else b)[:, j : j + n], axis=0)
                    conv = part if conv is None else np.add(conv, part, out=conv)
                pooled.append(conv.max(1) + self.p[f"b{w}"])
            s = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["d"] + self.p["c"]
            s = np.exp(s - s.max(1, keepdims=True))
            out[a : a + rows] = s / s.sum(1, keepdims=True)
        return out


def train(docs: DataFrame, sample_per_label: int = 256) -> ByteCNN | None:
    """A network for the labels in docs (doc_id, text, lang), or None if no row has both text and label."""
    sample = training_windows(docs, sample_per_label)
    if not sample:
        return None
    labels = sorted({lang for lang, _ in sample})
    return ByteCNN(labels).fit(padded([w for _, w in sample]), np.array([labels.index(lang) for lang, _ in sample])).ready()


def has_letter(text: str) -> bool:
    found = LETTER(text)
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def predict(docs: DataFrame, model: ByteCNN | None, names: tuple[str, str] = ("lang_pred", "score"), batch_bytes: int = 4 << 20) -> DataFrame:
    """docs with two more columns (names): the label of the greatest mean probability over all windows of the whole text,
    and that probability.

    Windows count by their bytes. `und` and score 0 where the text is null or has no letter, or nothing was learned. Rows
    keep their number and columns.
    """
    model_b = docs.sparkSession.sparkContext.broadcast(model)

    def score(net: ByteCNN, texts: list[bytes]) -> list[tuple[str, float]]:
        counts = [-(-len(t) // WINDOW) for t in texts]
        flat = np.frombuffer(b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts)), np.uint8).reshape(-1, WINDOW)
        weight = np.full(len(flat), float(WINDOW))
        ends = np.cumsum(counts)
        weight[ends - 1] = [len(t) - (n - 1) * WINDOW for t, n in zip(texts, counts)]
        total = np.add.reduceat(net.probabilities(flat) * weight[:, None], ends - counts, axis=0)
        best = total.argmax(1)
        return [(net.labels[k], float(min(1.0, max(0.0, row[k] / len(t))))) for k, row, t in zip(best, total, texts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model_b.value
        for batch in (piece for whole in batches for piece in pieces(whole, "text", batch_bytes)):
            out: list[tuple[str, float]] = [("und", 0.0)] * len(batch)
            held, where, size = [], [], 0
            for i, value in enumerate(batch.column(batch.schema.get_field_index("text"))):
                text = value.as_py()
                if net is not None and text is not None and has_letter(text):
                    held.append(text.encode())
                    where.append(i)
                    size += len(held[-1])
                if held and (size > batch_bytes or i + 1 == len(batch)):
                    for j, found in zip(where, score(net, held)):
                        out[j] = found
                    held, where, size = [], [], 0
            if held:
                for j, found in zip(where, score(net, held)):
                    out[j] = found
            columns = [*batch.columns, pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def identify(docs: DataFrame, folds: int = 3, held_out_fold: int = 1, sample_per_label: int = 256) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the labelled rows outside held_out_fold, applied to all rows."""
    trained = train(docs.where(fold("doc_id", folds) != held_out_fold), sample_per_label)
    found = predict(docs.select(F.col("doc_id").cast("long"), "text"), trained)
    return found.select("doc_id", (fold("doc_id", folds) == held_out_fold).alias("held_out"), "lang_pred", "score")


def clear_rows(docs: DataFrame, least_score: float, folds: int = 3, held_out_fold: int = 1, sample_per_label: int = 256) -> DataFrame:
    """The rows of docs whose text has a language (as identify() finds it) at least_score or more, each judged by its own text."""
    names = free_names(docs, "lang_pred", "score")
    found = predict(docs, train(docs.where(fold("doc_id", folds) != held_out_fold), sample_per_label), tuple(names))
    return found.where((F.col(names[0]) != "und") & (F.col(names[1]) >= least_score)).select(*[F.col(f"`{c}`") for c in docs.columns])
