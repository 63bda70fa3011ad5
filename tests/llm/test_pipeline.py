import hashlib

import corpus_pipeline
from tokenizers import Tokenizer

from test_minhash import brute
from vitalstream.llm import langid, mixing, secrets
from vitalstream.llm.queries import BPE_FILE


def documents_of(spark, tmp_path):
    """A copy of the smallest table with odd rows and a column of its own."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(90001, None, "en", "s"), (90002, "", "en", None), (90003, "123 456", None, "s"), (90004, "token = abcdef0123456789abcdef0123456789 the and of with", "en", "s")]
    more = spark.createDataFrame([(*r, len(r[1] or "")) for r in odd], rows.schema)
    both = rows.unionByName(more).selectExpr("*", "doc_id * 2 AS taken")
    both.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_stages_against_brute_force(spark, tmp_path):
    sf = documents_of(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        path = f"{tmp_path}/{name}.parquet"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before, docs)
        assert name == "tokens" or docs.columns == columns

    before, after = seen["language"]
    kept = {r.doc_id for r in after.collect()}
    assert {90001, 90002, 90003}.isdisjoint(kept) and 90004 in kept
    found = {r.doc_id: r for r in langid.identify(before).collect()}
    assert kept == {i for i, r in found.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}

    before, after = seen["near_duplicates"]
    groups = brute([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {i for i, (_, root) in groups.items() if i == root}

    before, after = seen["secret_scan"]
    spans = {r.doc_id: r.spans for r in secrets.scan(before).collect()}
    texts = {r.doc_id: r for r in after.collect()}
    assert set(texts) == set(spans)
    for r in before.collect():
        out, at = "", 0
        for s in spans[r.doc_id]:
            if s.start >= at:
                out += r.text[at : s.start] + "[secret]"
            at = max(at, s.end)
        assert texts[r.doc_id].text == out + r.text[at:] and texts[r.doc_id].n_chars == len(texts[r.doc_id].text)
    assert "abcdef0123456789" not in texts[90004].text

    before, after = seen["mixture"]
    want = {r.doc_id: r.taken // r.size for r in mixing.mix(before, whole=True).collect() if r.taken}
    got = {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want

    lib = Tokenizer.from_file(BPE_FILE)
    before, after = seen["tokens"]
    text_of = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        ids = lib.encode(text_of[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(text_of[r.doc_id].encode()).hexdigest()

    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in after.collect())


def test_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_under_shared_and_missing_ids(spark, tmp_path):
    """Two texts under one id, rows without an id and repeated rows, through every stage: each row is judged by itself."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = [r.text for r in rows.where("lang = 'en' and length(text) between 300 and 3000").orderBy("doc_id").limit(40).collect()]
    groups = brute(list(enumerate(some)))
    plain = [" ".join(reversed(t.split())) for i, t in enumerate(some) if groups[i][1] == i]  # like no other document
    secret = lambda i: f" password=hunter{i}secret{i} "
    odd = [(70001, plain[0] + secret(1)), (70001, "!! 12345"), (None, plain[1] + secret(2)), (None, "?"), (None, plain[2] + secret(3)), (None, None), (70001, plain[3] + secret(4))]
    odd += [(70002, plain[4] + secret(5))] * 3 + [(None, plain[5] + secret(6))] * 3
    more = spark.createDataFrame([(i, t, "en", "s9", len(t or "")) for i, t in odd], rows.schema)
    docs = rows.where("doc_id % 7 = 0").unionByName(more)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "")
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        texts = [r.text for r in docs.where("source = 's9'").collect()]
        if name == "language":
            assert sorted(texts) == sorted(t for _, t in odd if t and len(t) > 10)
        elif name == "near_duplicates":
            assert sorted(texts) == sorted({t for _, t in odd if t and len(t) > 10})
        else:
            assert all("hunter" not in t and "[secret]" in t for t in texts)
            assert name == "mixture" or len(texts) == 6
