"""Prefix trie of conversations by vertical bitmaps.

Conversations are dealt out in ranges of their ids. A shard of some thousand of them indexes each (position, turn) to the
bitset of its conversations; depth-first, a node's bitset is intersected with the posting of its first open member's next
turn, which gives a child, its members and, where members have no next turn, the node's list of ends. A node is known by the
XOR of 128-bit hashes of its (position, turn)s, so the same node of several shards meets by that key and its counts add up.

A node is then named by its smallest member and its depth: each conversation names one stretch of its own path, from some
depth to its end, and the stretches form a tree. Sums over subtrees go up that tree by pointer doubling, and along a stretch
by running sums.

No step needs a conversation, a node's members or a node's children in one task at once: turns are numbered by ranges, long
conversations are cut into pieces of PIECE turns which know the key of what precedes them, and frequent parents are spread.
Only the hash over a node's ends has to see them in order, one after the other, in runs of a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from .common import WORD, materialize, release

#: Turns of a piece, and the pieces and turns of a shard.
PIECE, SHARD_PIECES, SHARD_TURNS = 512, 2048, 100_000
#: Conversations share the first turns of the one that begins their group of so many ids, as many as a hash below HEADS says.
GROUP, HEADS = 20, 4


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, key, words, share, given), (conv_id, turns, share, given)), both written: turns with their place from 1,
    and conversations with their number of turns.

    key is a digest of role and text. share is how many turns of its group's first conversation a conversation would take
    over, given how many there are.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    turns = turns.withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    dealt = turns.repartitionByRange(_partitions(turns), *order, "row").sortWithinPartitions(*order).drop("row", "turn")
    dealt = materialize(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    # A conversation lies in one range, or in several that follow each other.
    parts = dealt.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    every, earlier = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(every).alias("turns")))
    sizes = parts.where("before = 0").select("conv_id", "turns")
    heads = sizes.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("head"), F.col("turns").alias("head_turns"))
    head, share = F.col("conv_id") - F.col("conv_id") % GROUP, F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    sizes = sizes.withColumn("head", head).join(heads, "head", "left").withColumn("share", share)
    sizes = materialize(sizes.select("conv_id", "turns", "share", F.least("share", F.coalesce("head_turns", F.lit(0))).alias("given")))
    placed = dealt.join(parts.drop("turns").join(sizes, "conv_id"), ["conv_id", "part"])
    placed = materialize(placed.select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "key", "words", "turns", "share", "given"))
    release(dealt)
    release(parts)
    return placed, sizes


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, last, words, k1, k2): the turns of every rebuilt conversation from place 1, last where it ends, and the
    128-bit hash of (pos, turn). A conversation without turns has one row, at place 0."""
    placed, sizes = numbered_turns(conversations)
    length = F.col("given") + F.greatest(F.col("turns") - F.col("share"), F.lit(0))
    own = placed.where("pos > share").select("conv_id", (F.col("pos") - F.col("share") + F.col("given")).alias("pos"), length.alias("length"), "key", "words")
    heads = placed.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("head"), "pos", "key", "words")
    takers = sizes.where("given > 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("head"), "given", length.alias("length"))
    taken = heads.join(takers, "head").where("pos <= given").select("conv_id", "pos", "length", "key", "words")  # at most GROUP takers of a head
    none = sizes.where(length == 0).select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words"))
    rows = own.unionByName(taken).unionByName(none)
    hashed = lambda *c: F.when(F.col("pos") > 0, F.xxhash64(*c)).otherwise(0)
    return rows.select("conv_id", "pos", (F.col("pos") == F.col("length")).alias("last"), "length", "words", hashed("pos", "key").alias("k1"), hashed("key", F.lit("second"), "pos").alias("k2"))


def pieces(turns: DataFrame) -> DataFrame:
    """turns with piece, its number in the conversation, and s1, s2, the node that precedes the piece."""
    cut = turns.withColumn("piece", F.expr(f"greatest(pos - 1, 0) div {PIECE}"))
    long = cut.where(F.col("length") > PIECE)
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    known = long.groupBy("conv_id", "piece").agg(F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2"))
    known = known.select("conv_id", "piece", *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).cast("long").alias(f"s{i}") for i in (1, 2)])
    zero = F.lit(0).cast("long")
    return cut.where(F.col("length") <= PIECE).withColumn("s1", zero).withColumn("s2", zero).unionByName(long.join(known, ["conv_id", "piece"])).drop("length")


NODE = "k1 long, k2 long, p1 long, p2 long, depth long, n long, conv_id long, words long, ends binary, first_end long"


def shard_nodes(rows: pa.Table, turns_of_piece: int) -> pa.RecordBatch:
    """The nodes of a shard of whole pieces, which come by conversation and place."""
    conv, piece, pos, s1, s2, k1, k2 = (rows[c].to_numpy() for c in ("conv_id", "piece", "pos", "s1", "s2", "k1", "k2"))
    starts = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (piece[1:] != piece[:-1])))
    stops = np.append(starts[1:], len(conv))
    turns = [0 if pos[s] == 0 else e - s for s, e in zip(starts.tolist(), stops.tolist())]
    closed = rows["last"].to_numpy(zero_copy_only=False)[stops - 1]
    starts, owner = starts.tolist(), conv[starts].tolist()
    keys, words = list(zip(k1.tolist(), k2.tolist())), rows["words"].to_numpy().tolist()
    postings: dict[tuple[int, int], int] = {}
    begins: dict[tuple[int, int, int], int] = {}
    for i, (s, n) in enumerate(zip(starts, turns)):
        bit = 1 << i
        for key in keys[s : s + n]:
            postings[key] = postings.get(key, 0) | bit
        begin = int(piece[s]), int(s1[s]), int(s2[s])
        begins[begin] = begins.get(begin, 0) | bit
    out: list[tuple] = []
    for (no, a, b), members in begins.items():
        # The node before a later piece is a node of the piece before, only its children are here.
        waiting = [(members, 0, a, b, None, None, 0)]
        while waiting:
            members, r, a, b, pa_, pb_, last_words = waiting.pop()
            ends, rest = [], members
            while rest:
                low = rest & -rest
                i = low.bit_length() - 1
                if turns[i] == r:
                    rest ^= low
                    if closed[i]:
                        ends.append(owner[i])
                    continue
                at = starts[i] + r
                child = members & postings[keys[at]]
                rest &= ~child
                waiting.append((child, r + 1, a ^ keys[at][0], b ^ keys[at][1], a, b, words[at]))
            if no == 0 or r:
                first = owner[(members & -members).bit_length() - 1]
                listed = ",".join(map(str, ends)).encode() if ends else None
                out.append((a, b, pa_, pb_, no * turns_of_piece + r, members.bit_count(), first, last_words, listed, ends[0] if ends else None))
    kinds = [pa.int64()] * 8 + [pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in NODE.split(", ")])


def nodes_of_shards(turns: DataFrame) -> DataFrame:
    """The nodes of every shard (NODE). Shards are cut where a task has read enough whole pieces, so each is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found = count = 0
        before = None
        for batch in batches:
            conv, piece = batch.column("conv_id").to_numpy(), batch.column("piece").to_numpy()
            start = 0
            new = np.append(before is None or (conv[0], piece[0]) != before, (conv[1:] != conv[:-1]) | (piece[1:] != piece[:-1])) if len(conv) else []
            for at in np.flatnonzero(new).tolist():
                if found >= SHARD_PIECES or count + at - start >= SHARD_TURNS:
                    yield shard_nodes(pa.Table.from_batches([*held, batch.slice(start, at - start)]).combine_chunks(), PIECE)
                    held, found, count, start = [], 0, 0, at
                found += 1
            if len(conv):
                held.append(batch.slice(start))
                count += len(conv) - start
                before = conv[-1], piece[-1]
        if held:
            yield shard_nodes(pa.Table.from_batches(held).combine_chunks(), PIECE)

    dealt = turns.repartitionByRange(_partitions(turns), "conv_id", "piece").sortWithinPartitions("conv_id", "pos")
    return dealt.mapInArrow(run, NODE)


def end_digests(local: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256) of the nodes at which conversations end: SHA-256 of all their ids, in order. The runs of the
    shards come sorted and are hashed one after the other, none is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [()] * 4, [pa.int64()] * 3 + [pa.string()])], ["k1", "k2", "depth", "ends_sha256"])
        for batch in batches:
            for *now, ends in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                if now != key:
                    if digest:
                        done.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ends.as_py())
            yield batch_of()
            done = []
        if digest:
            done.append((*key, digest.hexdigest()))
            yield batch_of()

    runs = local.where("ends is not null").repartition(_partitions(local), "k1", "k2", "depth").sortWithinPartitions("k1", "k2", "depth", "first_end")
    return runs.select("k1", "k2", "depth", "ends").mapInArrow(run, "k1 long, k2 long, depth long, ends_sha256 string")


def with_parents(local: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, words, ends_sha256) of every node, once."""
    merged = local.groupBy("k1", "k2", "depth").agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = materialize(merged.join(end_digests(local), ["k1", "k2", "depth"], "left"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    kinds = nodes.select("p1", "p2", "depth", "conv_id", "n_convs", "words", "ends_sha256")
    tree = spread_join(kinds, parents, ["p1", "p2", "depth"], F.col("conv_id"), nodes.count(), how="left")
    out = materialize(tree.select("conv_id", "depth", "parent_conv_id", "n_convs", "words", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))
    release(nodes)
    return out


def _saved() -> Column:
    return (F.col("n_convs") - 1) * F.col("words")


def stretch_totals(stretches: DataFrame, rounds: int = 64) -> DataFrame:
    """(conv_id, saved, leaves) summed over each stretch and all that hang on it, of stretches (conv_id, up, saved, leaves).

    In round k a stretch holds the sums of all below it that are nearer than 2^k, and adds those of the ones at that distance.
    """
    state = materialize(stretches)
    for _ in range(rounds):
        open_ = state.where("up is not null")
        total = open_.count()
        if not total:
            return state.select("conv_id", "saved", "leaves")
        more = open_.groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"))
        ups = state.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        jumped = spread_join(open_.select("conv_id", "up"), ups, ["up"], F.col("conv_id"), total).select("conv_id", F.col("next").alias("up"))
        added = state.drop("up").join(more, "conv_id", "left").join(jumped, "conv_id", "left")
        old, state = state, materialize(added.select("conv_id", "up", (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")))
        release(old)
    raise RuntimeError(f"stretches hang deeper than 2^{rounds}")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per trie node of conversations (conv_id, turn, role, text), as the columns say: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; equal turns by a digest of role and text, so repeated rows are turns of their own,
    one after the other. Null role or text is ''. Rows without a conv_id belong to no conversation and are left out; remainders
    of negative ids are those of SQL. A rebuilt conversation may have no turns and is then a member of the root only. An empty
    table has no root and gives no rows. Other columns are ignored.
    """
    local = materialize(nodes_of_shards(pieces(rebuilt(conversations))))
    tree = with_parents(local)
    release(local)
    children = tree.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    tree = materialize(tree.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    leaf = (F.col("n_children") == 0).cast("long")
    own = tree.groupBy("conv_id").agg(F.sum(_saved()).alias("saved"), F.sum(leaf).alias("leaves"), F.min_by("parent_conv_id", "depth").alias("up"), F.min("depth").alias("top"))
    own = materialize(own)
    totals = stretch_totals(own.select("conv_id", "up", "saved", "leaves"))
    hung = own.where("up is not null").select("conv_id", "up", "top").join(totals, "conv_id")
    hung = hung.groupBy(F.col("up").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves"))
    whole = tree.join(hung, ["conv_id", "depth"], "left").withColumn("part", F.expr(f"depth div {PIECE}"))
    whole = whole.withColumn("saved", _saved() + F.coalesce("hung_saved", F.lit(0))).withColumn("leaves", leaf + F.coalesce("hung_leaves", F.lit(0)))
    # Running sums from the end of each stretch: inside a part of it, on top of what the deeper parts have.
    part_sums = whole.groupBy("conv_id", "part").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    part_sums = part_sums.select("conv_id", "part", F.coalesce(F.sum("s").over(deeper), F.lit(0)).alias("s"), F.coalesce(F.sum("l").over(deeper), F.lit(0)).alias("l"))
    inside = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = whole.withColumn("saved", F.sum("saved").over(inside)).withColumn("leaves", F.sum("leaves").over(inside)).join(part_sums, ["conv_id", "part"])
    return placed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.col("l")).alias("n_leaves"), (F.col("saved") + F.col("s")).alias("saved_tokens"), "ends_sha256")


#: The same in SQL, prefix by prefix. The first steps are CRC-32 by its rule, as the database has no such function.
TRIE_SQL = r"""
WITH RECURSIVE steps(n, v, k) AS (
  SELECT n, n, 0 FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM steps WHERE k = 8),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, md5(length(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, ''))) AS pos,
    md5(length(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, '')) AS k,
    CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
digits(conv_id, rest, c) AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), 4294967295::BIGINT FROM turns
  UNION ALL SELECT conv_id, rest[2:], xor(c >> 8, t[(xor(c, ascii(rest)) & 255) + 1]) FROM digits, crc WHERE rest <> ''),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS head, xor(c, 4294967295) % 4 AS h FROM digits WHERE rest = ''),
built AS (
  SELECT c.conv_id, t.pos, t.k, t.words FROM convs c JOIN turns t ON t.conv_id = c.head WHERE t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos, t.k, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE t.pos > c.h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d, k, words FROM built),
paths AS (
  SELECT conv_id, d, md5(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d)) AS p, words FROM placed
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, MAX(d) AS length FROM paths GROUP BY 1),
nodes AS (SELECT p, d, MIN(conv_id) AS conv_id, COUNT(*) AS n, any_value(words) AS words FROM paths GROUP BY 1, 2),
parents AS (
  SELECT n.*, u.p AS parent, u.conv_id AS parent_conv_id FROM nodes n LEFT JOIN paths x ON x.conv_id = n.conv_id AND x.d = n.d - 1
  LEFT JOIN nodes u ON u.p = x.p AND u.d = x.d),
kids AS (SELECT parent AS p, d - 1 AS d, COUNT(*) AS n_children FROM parents WHERE parent IS NOT NULL GROUP BY 1, 2),
sums AS (
  SELECT a.p, a.d, CAST(SUM(CASE WHEN k.p IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(SUM((v.n - 1) * v.words) AS BIGINT) AS saved_tokens
  FROM nodes v JOIN paths a ON a.conv_id = v.conv_id AND a.d <= v.d LEFT JOIN kids k ON k.p = v.p AND k.d = v.d GROUP BY 1, 2),
ends AS (SELECT x.p, x.d, string_agg(CAST(x.conv_id AS VARCHAR), ',' ORDER BY x.conv_id) AS listed FROM paths x JOIN lengths l ON l.conv_id = x.conv_id AND l.length = x.d GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, n.parent_conv_id, n.n AS n_convs, COALESCE(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(COALESCE(e.listed, '')) AS ends_sha256
FROM parents n JOIN sums s ON s.p = n.p AND s.d = n.d LEFT JOIN kids k ON k.p = n.p AND k.d = n.d LEFT JOIN ends e ON e.p = n.p AND e.d = n.d
"""
