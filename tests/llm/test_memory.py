"""What Python workers hold: tables of words and pieces of batches are bounded, and do not outlive a task."""

import pyarrow as pa

from vitalstream.llm import bpe, minhash, runs
from vitalstream.llm.common import pieces
from vitalstream.llm.queries import BPE_FILE


def test_pieces_are_bounded_and_whole():
    texts = ["a" * 30, None, "", "b" * 500, "c" * 60, "\u00e9" * 40, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    found = list(pieces(batch, most_bytes=100))
    assert [r for p in found for r in p.to_pylist()] == batch.to_pylist()
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p["text"].to_pylist()) <= 100 for p in found)
    assert [len(p) for p in pieces(batch.slice(1, 5), 1, 100)] == [2, 1, 1, 1]
    assert list(pieces(batch.slice(0, 0), 1, 100)) == []


def test_runs_of_groups_are_bounded_and_whole():
    keys = [k for k, n in enumerate([3, 1, 9, 2, 2, 4, 1, 1]) for _ in range(n)]
    rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(range(len(keys)))], ["k", "n"])
    for cut in (4, 100):
        found = list(runs.key_runs([rows.slice(0, 8), rows.slice(8)], ["k"], cut))
        assert [n for t, _ in found for n in t["n"].to_pylist()] == list(range(len(keys)))
        assert all(len(t) <= cut or len(s) == 1 for t, s in found)
        for t, starts in found:
            assert starts.tolist() == runs.group_starts(t, ["k"]).tolist()
        seen = [set(t["k"].to_pylist()) for t, _ in found]
        assert sum(map(len, seen)) == len(set(keys))


def test_table_of_word_hashes_is_bounded_inside_a_text():
    text = " ".join(map(str, range(2 * minhash.MEMO))) + " " + "x" * 100_000
    memo = {}
    got = minhash.shingle_hashes(text, memo)
    assert len(memo) <= minhash.MEMO and max(map(len, memo)) <= minhash.MEMO_BYTES
    assert got.tolist() == minhash.shingle_hashes(text).tolist() and len(got) == 2 * minhash.MEMO - 3


def test_workers_keep_no_words_after_a_task(spark, corpus):
    bpe.round_trip(spark, corpus.repartition(8), BPE_FILE, with_ids=True).write.format("noop").mode("overwrite").save()

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(e.memo) for e in bpe._loaded.values())] * len(batch))], ["n"])

    assert {r.n for r in spark.range(8).repartition(8).mapInArrow(held, "n long").collect()} == {0}
