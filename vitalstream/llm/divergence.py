"""Quality rules: how far a document's histograms lie from those of its language.

Each language that holds a thousandth of all words has a reference, made of all its documents: how often each character
class occurs, and how often each of its COMMON most frequent words does (all other words are one more class). A document's
own two histograms are compared with it by the Jensen-Shannon distance (base 2, so from 0 to 1). Short texts scatter more, so
the distance allowed shrinks with the root of the length, and below a minimum length a histogram is not judged at all.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Words of a reference, their greatest length, and the part of all words that a language with a reference has: so there are
#: at most LANGUAGES references whatever the data, which is what bounds the broadcast.
COMMON, LONGEST, LANGUAGES = 48, 20, 1000
#: Texts with fewer words or characters are not judged by that histogram.
LEAST_WORDS, LEAST_CHARS = 50, 200
#: The distance allowed to a histogram of n entries: FLAT + SCATTER / sqrt(n).
WORDS_FLAT, WORDS_SCATTER = 0.2, 1.6
CHARS_FLAT, CHARS_SCATTER = 0.12, 3.0
#: Character classes in order: small, capital and other letters of ASCII or not, digits, blanks, points, symbols, the rest.
CLASSES = 8
SMALL, CAPITAL, LETTER, DIGIT, BLANK, POINT, SYMBOL, REST = range(CLASSES)
#: Fixed values of the base rules.
SYMBOLS, POINTS = "#*$%&|<>", ".,;:!?'\"()-"
LEAST_BASE_WORDS, MOST_REPEATED = 50, 50


def _class_of(code: int) -> int:
    c = chr(code)
    if c in POINTS:
        return POINT
    kind = unicodedata.category(c)
    if kind == "Lu":
        return CAPITAL
    if kind[0] == "L" or kind[0] == "M":
        return SMALL if code < 128 else LETTER
    if kind[0] == "N":
        return DIGIT
    if c.isspace():
        return BLANK
    return SYMBOL if code < 128 else REST


_classes: list[np.ndarray] = []


def class_counts(text: str) -> np.ndarray:
    """How many characters of each class a text has."""
    if not _classes:
        _classes.append(np.array([_class_of(i) for i in range(0x10000)], np.uint8))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_classes[0][np.minimum(codes, 0xFFFF)], minlength=CLASSES)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 1 if one of them is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


class Reference:
    """The histograms of one language."""

    def __init__(self, chars: list[int], words: dict[str, int], total: int):
        self.chars = np.array(chars, float)
        self.places = {w.encode(): i for i, w in enumerate(words)}
        self.words = np.array([*words.values(), total - sum(words.values())], float)

    def word_counts(self, counted: Counter[bytes]) -> np.ndarray:
        own = np.zeros(len(self.places) + 1)
        for word, place in self.places.items():
            own[place] = counted.get(word, 0)
        own[-1] = counted.total() - own.sum()
        return own


def references(docs: DataFrame) -> dict[str, Reference]:
    """The references by language, of all rows of docs with a language; every text and every word counts.

    Words are counted by Spark, and of each language only its most frequent ones come to the driver: at most LANGUAGES
    languages, COMMON words of each.
    """
    told = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text")).where("lang is not null")

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                own = np.append(class_counts(text), len(text.encode("utf-8", "surrogatepass").split()))
                sums[lang] = sums[lang] + own if lang in sums else own
            if len(sums) > LANGUAGES:
                yield batch_of(sums)
                sums = {}
        yield batch_of(sums)

    def batch_of(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], ["lang", "n"])

    counted = told.mapInArrow(classes, "lang string, n array<long>")
    summed = counted.groupBy("lang").agg(*[F.sum(F.col("n")[i]).alias(f"c{i}") for i in range(CLASSES + 1)])
    every = summed.agg(F.sum(f"c{CLASSES}").alias("every"))
    large = summed.join(every, F.col(f"c{CLASSES}") * LANGUAGES >= F.col("every")).where(F.col(f"c{CLASSES}") > 0).drop("every").collect()
    if not large:
        return {}
    words = told.where(F.col("lang").isin([r.lang for r in large])).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    # Only words of letters: marks and rules of lines are no words of a language.
    words = words.where((F.length("word") <= LONGEST) & F.col("word").rlike(r"^\p{L}+$"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    often = words.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("place", place).where(F.col("place") <= COMMON)
    lists: dict[str, list] = {r.lang: [] for r in large}
    for r in often.orderBy("lang", "place").collect():
        lists[r.lang].append((r.word, r.n))
    return {r.lang: Reference([r[f"c{i}"] for i in range(CLASSES)], dict(lists[r.lang]), r[f"c{CLASSES}"]) for r in large}


def repeated_words(words: list[bytes]) -> int:
    """The words that lie in a window of three words which the text has twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, window, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


_has_word = re.compile(WORD).search


def base_counts(text: str) -> tuple[list[bytes], int, int, int, int]:
    """(words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only
    lines = [x for x in text.split("\n") if _has_word(x)]
    blanks = sum(map(text.count, "\t\n\x0b\x0c\r "))
    return words, len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _near(own: np.ndarray, there: np.ndarray, n: int, least: int, flat: float, scatter: float) -> tuple[float, bool]:
    d = distance(own, there)
    return d, n < least or d <= flat + scatter / n**0.5


def judged(words: list[bytes], text: str, lang: str | None, known: dict[str, Reference]) -> tuple[float | None, float | None, bool]:
    """(char_distance, word_distance, verdict) of a text.

    A text passes if both its histograms lie within the allowed distance of its language's reference, or of another one's, as
    a language can be noted wrongly. Where its language has no reference only its characters are compared, with the nearest
    reference. The distances told are those to its language, else to the nearest; null where nothing was compared.
    """
    if not known or not text:
        return None, None, True
    chars = class_counts(text)
    near = lambda ref: _near(chars, ref.chars, len(text), LEAST_CHARS, CHARS_FLAT, CHARS_SCATTER)
    if lang not in known:
        d, fine = min((near(ref) for ref in known.values()), key=lambda x: x[0])
        return d, None, fine
    counted = Counter(w.lower() if w.isascii() else w.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass") for w in words)
    told = None
    for ref in chain([known[lang]], (ref for other, ref in known.items() if other != lang)):
        (a, fine_a), (b, fine_b) = near(ref), _near(ref.word_counts(counted), ref.words, len(words) or 1, LEAST_WORDS, WORDS_FLAT, WORDS_SCATTER)
        told = told or (a, b)
        if fine_a and fine_b:
            return *told, True
    return *told, False


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): the base counts, base_failed, kept, char_distance and word_distance.

    A null text counts as '', which has no words and so fails the base rules, as does each text of fewer than 50 words or
    with more than half of its words in repeated windows. kept is false there, else the verdict of judged(). Null and repeated
    ids and repeated rows keep a row each; a null language is one without a reference. Other columns are ignored. An empty
    table gives an empty result. The texts are read three times and only words with their counts are shuffled.
    """
    known = docs.sparkSession.sparkContext.broadcast(references(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(2).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                words, *base = base_counts(text)
                failed = len(words) < LEAST_BASE_WORDS or 100 * base[3] > MOST_REPEATED * len(words)
                *told, fine = judged(words, text, lang, known.value)
                rows.append((len(words), *base, failed, fine and not failed, *told))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, SCHEMA)
