"""What the pipeline's stages shuffle and compare."""

import random

from vitalstream.llm import minhash, mixing


def test_texts_are_not_mixed(spark, monkeypatch):
    """Only numbers go through the mix's windows and joins; rows come out as often as they are taken."""
    seen, mix = [], mixing.mix

    def watched(*args, **options):
        seen.append(mix(*args, **options))
        return seen[-1]

    monkeypatch.setattr(mixing, "mix", watched)
    docs = spark.createDataFrame([(i // 2, f"w{i} " * (i % 5), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    rows = mixing.mixed_documents(docs).collect()
    assert {k for _, k in seen[0].dtypes[6:]} == {"bigint"}
    assert rows and {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect() if r.text}


def test_the_smallest_id_is_met_first_whatever_the_order_of_rows(spark, monkeypatch):
    """Copies of one text that are less like each other than like it: pairs among them are not looked at once it has met them."""
    rng, looked = random.Random(5), []
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for i in range(60):
        copy = list(words)
        for at in rng.sample(range(200), 4):
            copy[at] = f"x{i}y{at}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)] + [(0, " ".join(words))], "doc_id long, text string").coalesce(1)
    alike = minhash.alike

    def watched(*args):
        looked.append(alike(*args))
        return looked[-1]

    monkeypatch.setattr(minhash, "alike", watched)
    kept = minhash.one_of_each(docs)
    assert [r.doc_id for r in kept.collect()] == [0]
    assert looked[0].count() < 60
