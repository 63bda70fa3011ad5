"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, ctw, divergence, html, langid, minhash, mixing, neighbours, repeats, rotated, secrets, trie
from .common import table

#: The vocabulary file of op2_bpe and of the pipeline's last stage.
BPE_FILE = str(public_tokenizers.path("byte_bpe_50k.json"))
#: The other vocabulary of op13_align.
PIECE_FILE = str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(spark, table(spark, sf_dir, "documents"), BPE_FILE)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 50 = 0"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.rules(table(spark, sf_dir, "documents"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), BPE_FILE, PIECE_FILE)


QUERIES = {f.__name__: f for f in (op1_rotated, op2_bpe, op3_neighbours, op4_secrets, op5_ctw, op6_repeats, op7_minhash, op8_html, op9_langid, op10_mixing, op11_trie, op12_divergence, op13_align)}
ORACLE_SQL = {"op10_mixing": mixing.MIX_SQL, "op11_trie": trie.TRIE_SQL}
