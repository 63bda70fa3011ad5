import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vitalstream.llm import bpe
from vitalstream.llm.queries import BPE_FILE

ODD = ["", " ", "a<|endoftext|>b<|endoftext|>", " " * 4000, "=" * 700 + "a" * 700, "\n\n \t x", "日本語 😀😀 été", "don't we'll I'VE ²½ Ⅷ", "\x00\x1c\x85  x", "ab" * 20000]


@pytest.fixture(scope="module")
def pair():
    return bpe.ForcedBoundaryBPE(bpe.read_vocabulary(BPE_FILE)), Tokenizer.from_file(BPE_FILE)


def test_equals_the_library(pair):
    own, lib = pair
    for text in ODD:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(pair, text):
    own, lib = pair
    assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)) == text


def test_cuts_are_forced(pair):
    own, _ = pair
    raw = "naïve été 漢字".encode()
    parts = list(own.fragments(raw))
    assert b"".join(parts) == raw and len(parts) > 1
    assert not any(p[-1:] + q[:1] in t for p, q in zip(parts, parts[1:]) for t in own.token_bytes[:50256])


def test_queries_on_rows(spark, documents):
    frame = documents([(i, t, "en", None) for i, t in enumerate(ODD)] + [(99, None, None, "a"), (99, None, None, "a"), (None, "x", None, None)])
    lib = Tokenizer.from_file(BPE_FILE)
    rows = bpe.round_trip(spark, frame, BPE_FILE).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        text = "x" if r.doc_id is None else "" if r.doc_id == 99 else ODD[r.doc_id]
        ids = lib.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode(spark, frame, BPE_FILE)
    texts = {r.doc_id: r.text for r in bpe.decode(spark, encoded, BPE_FILE).collect()}
    assert texts[6] == ODD[6] and texts[99] == ""
    assert bpe.round_trip(spark, frame.limit(0), BPE_FILE).collect() == []
