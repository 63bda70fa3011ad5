import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vitalstream.llm import align, bpe
from vitalstream.llm.queries import BPE_FILE, PIECE_FILE

ODD = [
    "", None, " ", "a", "a b", "a\nb", "\na", "a\n", "a \nb", "a\n b", "two  blanks", "tab\there", "a<|endoftext|>b", "<s> x </s>", "don't we'll I'VE ²½ Ⅷ", "日本語 😀😀 été", "▁x", "x▁ y",
    "\x00\x1c\x85  x", "nb\xa0sp  em", "\r\nline\r\n", "=" * 900 + " " + "a" * 900, " " * 900, "\n" * 900, "ab" * 2000, "the quick brown fox\njumps over the lazy dog. " * 40, "ẞ ǅ ﬁ é", "'s 's's \n's",
]


@pytest.fixture(scope="module")
def libs():
    a = Tokenizer.from_file(BPE_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE), align.Tokenizers(bpe.read_vocabulary(BPE_FILE), bpe.read_vocabulary(PIECE_FILE))


def tokens(libs, text):
    """[(id, end)] of both sides, or two empty lists, token by token."""
    a, b, _ = libs
    if not text:
        return [], []
    of_letter = {c: i for i, c in enumerate(bpe.byte_letters())}
    sides = []
    left = [(i, bytes(of_letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    for side in (left, right):
        if b"".join(x for _, x in side) != (" " + text).encode():
            return [], []
        ends, at = [], 0
        for i, raw in side:
            at += len(raw)
            ends.append((i, at))
        sides.append(ends)
    return sides


def plainly(libs, texts):
    """(rows, groups) without Arrow: the contract, token by token."""
    rows, listed, links = [], [], []
    for text in texts:
        a, b = tokens(libs, text)
        common = sorted({e for _, e in a} & {e for _, e in b})
        cut = lambda side, lo, hi: [i for i, e in side if lo < e <= hi]
        groups = [(cut(a, lo, hi), cut(b, lo, hi)) for lo, hi in zip([0, *common], common)]
        own = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append([len(a), len(b), len(groups), len(own), hashlib.sha256(text.encode()).hexdigest() if a else ""])
        listed.append(groups)
        links.append(own)
    counts = Counter(x for own in links for x in own)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    for row, own in zip(rows, links):
        row[4:4] = [sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own)]
    return rows, listed, counts


def test_ids_equal_the_libraries(libs):
    a, b, both = libs
    rng = random.Random(5)
    texts = [t for t in ODD if t] + ["".join(rng.choices("ab e\n'st.ß日 \t", k=rng.randint(1, 60))) for _ in range(400)]
    left, right = both.ids(pa.array(texts))
    for text, x, y in zip(texts, left.to_pylist(), right.to_pylist()):
        assert x == a.encode(" " + text, add_special_tokens=False).ids, text[:40]
        assert y == b.encode(text), text[:40]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=6))
def test_any_text(libs, texts):
    a, b, both = libs
    texts = [t for t in texts if t and not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    left, right = both.ids(pa.array(texts, pa.string()))
    assert left.to_pylist() == [a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert right.to_pylist() == [b.encode(t) for t in texts]


def test_equals_the_plain_form(spark, documents, libs, corpus, monkeypatch):
    monkeypatch.setattr(align, "CHUNK_BYTES", 20000)
    texts = ODD + [r.text for r in corpus.limit(60).collect()] + ["the quick brown fox"] * 30
    ids = [None, 7, 7, *range(len(texts) - 3)]
    docs = documents([(i, t, "en", "s") for i, t in zip(ids, texts)]).repartition(3)
    rows, groups, counts = plainly(libs, texts)
    got = align.alignment(docs, BPE_FILE, PIECE_FILE)
    key = lambda x: [v is None or v for v in x] and tuple(-1 if v is None else v for v in x)
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(key((i, *r)) for i, r in zip(ids, rows))
    found = align.pair_counts(docs, BPE_FILE, PIECE_FILE).collect()
    assert {(r.a_id, r.b_id): r.n for r in found} == counts
    cut = align.groups(docs.where("doc_id >= 0 and doc_id <> 7"), BPE_FILE, PIECE_FILE).orderBy("doc_id", "group_no").collect()
    wanted = [(i, no, x, y) for i, g in sorted(zip(ids[3:], groups[3:])) if i != 7 for no, (x, y) in enumerate(g)]
    assert [(r.doc_id, r.group_no, r.a_ids, r.b_ids) for r in cut] == wanted


def test_empty_table_and_all_empty(spark, documents):
    assert align.alignment(documents([]).limit(0), BPE_FILE, PIECE_FILE).collect() == []
    assert [tuple(r) for r in align.alignment(documents([(1, None, "en", "s"), (1, "", None, None)]), BPE_FILE, PIECE_FILE).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2
