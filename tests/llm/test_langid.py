import numpy as np
from zlib import crc32

from vitalstream.llm import langid


def test_held_out_accuracy(corpus):
    truth = {r.doc_id: r.lang for r in corpus.collect()}
    rows = langid.identify(corpus).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_undefined_cases(documents):
    rows = [(i, "der die und nicht eine " * 8, "de", "a") for i in range(30)] + [(100 + i, "the and with of this " * 8, "en", None) for i in range(30)]
    odd = [(1000, None, "de", "a"), (1001, "", None, "a"), (1002, "12 345 ++ ²", "en", "a"), (1003, "x", None, None), (1004, "nicht eine und " * 50000, None, "a"), (None, "the with this of and the", "en", "a")]
    got = {r.doc_id: r for r in langid.identify(documents(rows + odd + odd[:1])).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0.0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred in ("de", "en") and got[1004].lang_pred == "de" and got[None].lang_pred == "en"
    assert langid.identify(documents(rows).limit(0)).collect() == []
    unlabelled = langid.identify(documents([(5, "text", None, "a")])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


def test_whole_text_counts(documents):
    """A text whose first windows are in one language and whose many others are in another goes to the other."""
    rows = [(i, "der die und nicht eine " * 30, "de", "a") for i in range(40)] + [(100 + i, "the and with of this " * 30, "en", "a") for i in range(40)]
    long = (999, "der die und nicht eine " * 30 + "the and with of this " * 300, None, "a")
    assert {r.doc_id: r.lang_pred for r in langid.identify(documents([*rows, long])).collect()}[999] == "en"


def test_sample_is_bounded_by_label(documents):
    """Rows without an id, repeated ids and repeated rows take slots like others: one row of a slot."""
    rows = [(None, f"der die und nicht {i}", "de", "a") for i in range(600)] + [(7, f"the and with {i}", "en", "a") for i in range(600)] + [(8, "the same text", "en", "a")] * 600
    sample = langid.training_windows(documents(rows), 16)
    assert {lang: sum(x == lang for x, _ in sample) for lang in ("de", "en")} == {"de": 16, "en": 16}
    assert len(set(sample)) == 32


def test_rows_are_judged_by_their_own_text(documents):
    rows = [(i, "der die und nicht eine " * 8, "de", "a") for i in range(30)] + [(100 + i, "the and with of this " * 8, "en", None) for i in range(30)]
    odd = [(None, None, "de", "a"), (None, "12 345", "de", "a"), (5, "678", None, "a"), (None, "the and with of this " * 8, None, None)]
    frame = documents(rows + odd).selectExpr("*", "1 AS score", "'own' AS lang_pred")
    out = langid.clear_rows(frame, 0.3)
    assert out.columns == frame.columns
    want = [r for r in frame.collect() if r.text and "the" in r.text or r.text and "der" in r.text]
    assert sorted(map(str, out.collect())) == sorted(map(str, want)) and len(want) == 61


def test_lookup_tables_equal_the_convolution():
    rng = np.random.default_rng(3)
    net = langid.ByteCNN(["a", "b", "c"]).fit(rng.integers(0, 256, (60, langid.WINDOW)).astype(np.uint8), rng.integers(0, 3, 60), steps=5).ready()
    x = rng.integers(0, 256, (7, langid.WINDOW)).astype(np.uint8)
    for window, got in zip(x, net.probabilities(x, rows=3)):
        pooled = []
        for w in langid.WIDTHS:
            for f in range(langid.FILTERS):
                kernel = net.p[f"f{w}"][:, :, f]
                pooled.append(max(sum(net.p["e"][window[i + j]] @ kernel[j] for j in range(w)) for i in range(langid.WINDOW - w + 1)) + net.p[f"b{w}"][f])
        z = np.maximum(pooled, 0) @ net.p["d"] + net.p["c"]
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(got, want, atol=1e-4)


def test_labels_and_rows_of_training_are_bounded(documents):
    """One label of most rows, rows without an id, and more labels than the sample has documents for at full share."""
    rows = [(None, f"text number {i} of many", "en", None) for i in range(400)] + [(i, f"label {i}", f"l{i:03}", None) for i in range(50)]
    found = langid.training_windows(documents(rows), sample_per_label=8, windows_per_doc=2, sample_docs=120)
    labels = [lang for lang, _ in found]
    assert len(set(labels)) == 51 and labels.count("en") == 2 and len(found) == 52


def test_many_labels_are_learned(documents):
    """Labels beyond a minibatch, rare ones included, are predicted."""
    rng = np.random.default_rng(7)
    words = {f"l{k:02}": ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(4)] for k in range(80)}
    rows = [(100 * k + i, " ".join(rng.choice(words[lang], 40)), lang, None) for k, lang in enumerate(words) for i in range(60 if k == 0 else 6)]
    found = langid.identify(documents(rows)).collect()
    assert sum(r.lang_pred == f"l{r.doc_id // 100:02}" for r in found if r.held_out) >= 0.8 * sum(r.held_out for r in found)
