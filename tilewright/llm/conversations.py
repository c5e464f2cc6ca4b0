"""Conversation prefix trie: ternary search trees over dictionary-encoded turns, one for each range shard.

Turns get numbers from a dictionary of their digests, so texts are read once and never shuffled. Equal
conversations become one sequence, sequences are dealt out by range, and each block of them is a tree of its
own. A node that other blocks may hold as well (a prefix of a block's first or last sequence) leaves its tree as
a partial sum; these few are merged by the digest of their path and summed up to the root afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import drop_scratch, join_spread, materialise, n_words
from tilewright.llm.spelling import CRC32_SQL, crc32_sql

SHARED = 3  # the most turns that a conversation takes from the first of its family
FAMILY = 20
DEALT_BY = 16  # first turns of a sequence that say which range it is in; longer ones are salted
BLOCK_TURNS = 200_000  # turns of the sequences of one tree
CHUNK_BYTES = 32_768  # ids joined to one row before a list is hashed


def encoded_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation as numbers and word counts, in order of turn, null first.

    rows has conv_id, turn, role and text. Equal (role, text) have one number; turns of equal place are ordered by the
    SHA-256 of their role and text. Rows of a null conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = rows.where("conv_id is not null").select("conv_id", F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), key.alias("key"), n_words(text).alias("w"))
    turns = materialise(turns, "turns")
    book = turns.groupBy("key").agg(F.max("w").alias("w"), F.count("*").alias("copies"))
    book = materialise(book.select("key", F.monotonically_increasing_id().alias("id"), "w", "copies"), "book")
    met = join_spread(turns.drop("w"), book, ["key"], turns.count())
    own = met.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("known", "turn", "key", "id", "w"))).alias("turns"))
    return own.select("conv_id", F.transform("turns", lambda x: F.struct(x["id"].alias("id"), x["w"].alias("w"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation with its first turns taken from the first conversation of its family of 20 ids.

    How many, 0 to 3, is the crc32 of its id modulo 4; all there are if fewer, none if there is no such conversation.
    """
    own = materialise(own, "own")
    family = F.col("conv_id") % FAMILY
    heads = own.where(family == 0).select(F.col("conv_id").alias("_first"), F.slice("turns", 1, SHARED).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).cast("int")
    met = own.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - family).alias("_first")).join(heads, "_first", "left")
    none = F.array().cast("array<struct<id:bigint,w:bigint>>")
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return met.select("conv_id", turns.alias("turns"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the ids of equal cls, which come one after another, to texts of CHUNK_BYTES."""
    now, first, parts, size = None, 0, [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(parts)], pa.string())], names=["cls", "first", "ids"])

    for batch in batches:
        for cls, conv in zip(batch.column("cls").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if cls != now or size > CHUNK_BYTES:
                if parts:
                    yield out()
                now, first, parts, size = cls, conv, [], 0
            parts.append(str(conv))
            size += len(parts[-1]) + 1
    if parts:
        yield out()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the chunks of each cls, one after another: a list of any length is read as a stream."""
    now, state, done = None, None, []

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["cls", "ends"])

    for batch in batches:
        for cls, ids in zip(batch.column("cls").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if cls == now:
                state.update(b"," + ids.encode())
                continue
            if state:
                done.append((now, state.hexdigest()))
            now, state = cls, hashlib.sha256(ids.encode())
        if done:
            yield out(done)
            done = []
    if state:
        yield out([(now, state.hexdigest())])


def sequences(convs: DataFrame) -> DataFrame:
    """(ids, ws, n, low, ends) of the distinct sequences of turns: how many conversations have it, the smallest, and
    the hash of all their ids."""
    joined = F.array_join(F.transform("turns", lambda x: x["id"].cast("string")), ",")
    convs = materialise(convs.select("conv_id", "turns", F.unhex(F.sha2(joined, 256)).alias("cls")), "rebuilt")
    ids = convs.select("cls", "conv_id").repartitionByRange("cls", "conv_id").sortWithinPartitions("cls", "conv_id")
    ids = ids.mapInArrow(_chunks, "cls binary, first long, ids string")
    ends = ids.repartition("cls").sortWithinPartitions("cls", "first").mapInArrow(_hashes, "cls binary, ends string")
    kinds = convs.groupBy("cls").agg(F.any_value("turns").alias("turns"), F.count("*").alias("n"), F.min("conv_id").alias("low"))
    return kinds.join(ends.hint("merge"), "cls").select("cls", F.col("turns.id").alias("ids"), F.col("turns.w").alias("ws"), "n", "low", "ends")


class Tree:
    """A ternary search tree of sequences of numbers; entry 0 is the root of the trie, which has no number.

    lo and hi lead to smaller and larger siblings, eq to the siblings that follow. Entries stand behind their parents.
    """

    def __init__(self) -> None:
        self.key, self.lo, self.hi, self.eq, self.parent, self.depth = [0], [-1], [-1], [-1], [-1], [0]
        self.words, self.n, self.low, self.ends = [0], [0], [None], [None]

    def _new(self, key: int, parent: int, words: int) -> int:
        for column, value in ((self.key, key), (self.lo, -1), (self.hi, -1), (self.eq, -1), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.words, words), (self.n, 0), (self.low, None), (self.ends, None)):
            column.append(value)
        return len(self.key) - 1

    def insert(self, ids: list[int], words: list[int], n: int, low: int, ends: str) -> None:
        key, lo, hi, eq = self.key, self.lo, self.hi, self.eq
        here = 0
        for x, w in zip(ids, words, strict=True):
            at = eq[here]
            if at < 0:
                at = eq[here] = self._new(x, here, w)
            while key[at] != x:
                side = lo if x < key[at] else hi
                if side[at] < 0:
                    side[at] = self._new(x, here, w)
                at = side[at]
            here = at
        self.n[here], self.low[here], self.ends[here] = n, low, ends

    def build(self, rows: list[tuple]) -> None:
        """Inserts sorted rows, the middle one of each stretch first, so that siblings are balanced."""
        todo = [(0, len(rows))]
        while todo:
            a, b = todo.pop()
            if a < b:
                self.insert(*rows[(a + b) // 2])
                todo += [(a, (a + b) // 2), ((a + b) // 2 + 1, b)]


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tree for each block of sequences; a row for each node."""
    rows, turns = [], 0
    for batch in batches:
        ids, ws = batch.column("ids"), batch.column("ws")
        at = ids.offsets.to_pylist()
        values, words = ids.values, ws.values
        for k, (n, low, ends) in enumerate(zip(batch.column("n").to_pylist(), batch.column("low").to_pylist(), batch.column("ends").to_pylist(), strict=True)):
            rows.append((values.slice(at[k], at[k + 1] - at[k]).to_pylist(), words.slice(at[k], at[k + 1] - at[k]).to_pylist(), n, low, ends))
            turns += at[k + 1] - at[k] + 1
            if turns >= BLOCK_TURNS:
                yield from _nodes(rows)
                rows, turns = [], 0
    if rows:
        yield from _nodes(rows)


def _nodes(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    edges = [rows[0][0][:DEALT_BY], rows[-1][0][:DEALT_BY]]
    rows.sort(key=lambda r: r[0])
    tree = Tree()
    tree.build(rows)
    size = len(tree.key)
    # how far a node follows the first and the last sequence of the block; it may stand in other blocks as well if to its end
    shared, digest = [True] * size, [b""] + [None] * (size - 1)
    follows = [(True, True)] * size
    for u in range(1, size):
        p, d = tree.parent[u], tree.depth[u]
        if not shared[p]:
            shared[u] = False
        elif d > DEALT_BY:
            follows[u] = follows[p]
        else:
            follows[u] = tuple(f and len(e) >= d and e[d - 1] == tree.key[u] for f, e in zip(follows[p], edges, strict=True))
            shared[u] = any(follows[u])
        if shared[u]:
            digest[u] = hashlib.blake2b(digest[p] + tree.key[u].to_bytes(8, "little", signed=True), digest_size=16).digest()
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for u in range(size - 1, -1, -1):
        p = tree.parent[u]
        if p >= 0:
            tree.n[p] += tree.n[u]
            tree.low[p] = tree.low[u] if tree.low[p] is None else min(tree.low[p], tree.low[u])
        if not shared[u]:
            leaves[u] = leaves[u] if children[u] else 1
            saved[u] += (tree.n[u] - 1) * tree.words[u]
            children[p] += 1
            leaves[p] += leaves[u]
            saved[p] += saved[u]
    up = [None if p < 0 or not shared[p] else digest[p] for p in tree.parent]
    parent_low = [None if p < 0 or shared[p] else tree.low[p] for p in tree.parent]
    columns = [(digest, pa.binary()), (up, pa.binary()), (parent_low, pa.int64()), (tree.low, pa.int64()), (tree.depth, pa.int64()), (tree.n, pa.int64()), (children, pa.int64()), (leaves, pa.int64()), (saved, pa.int64()), (tree.words, pa.int64()), (tree.ends, pa.string())]
    for k in range(0, size, 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 10_000], t) for c, t in columns], names=NODE.split(" "))


NODE = "digest up parent_low low depth n children leaves saved words ends"
NODE_SCHEMA = "digest binary, up binary, parent_low long, low long, depth long, n long, children long, leaves long, saved long, words long, ends string"


def merged(parts: DataFrame) -> DataFrame:
    """The nodes that several blocks hold, with sums over their whole subtrees: (digest, up, low, depth, n, children, leaves, saved, ends).

    Sums go up 1, 2, 4, ... levels at a time, so the rounds are the logarithm of the depth.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    nodes = parts.groupBy("digest").agg(F.max("up").alias("up"), F.min("low").alias("low"), F.max("depth").alias("depth"), *sums, F.max("words").alias("words"), F.max("ends").alias("ends"))
    nodes = materialise(nodes, "shared")
    kids = nodes.where("up is not null").groupBy(F.col("up").alias("digest")).agg(F.count("*").alias("kids"))
    nodes = nodes.join(kids, "digest", "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0))).drop("kids")
    nodes = nodes.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves"))).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("words"))
    nodes = materialise(nodes, "shared")
    now = nodes.select("digest", F.col("up").alias("far"), "leaves", "saved")
    while not now.where("far is not null").isEmpty():
        more = now.where("far is not null").groupBy(F.col("far").alias("digest")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        farther = now.where("far is not null").select("digest", "far").join(now.select(F.col("digest").alias("far"), F.col("far").alias("next")), "far").select("digest", "next")
        after = now.join(more, "digest", "left").join(farther, "digest", "left")
        after = materialise(after.select("digest", F.col("next").alias("far"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "sums")
        if now.inputFiles() != nodes.inputFiles():
            drop_scratch(now)
        now = after
    return nodes.drop("leaves", "saved", "words").join(now.drop("far"), "digest")


def trie_nodes(seqs: DataFrame) -> DataFrame:
    """A row for each node of the trie of sequences(): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    place = [F.slice("ids", 1, DEALT_BY), F.when(F.size("ids") > DEALT_BY, F.xxhash64("cls"))]
    dealt = seqs.repartitionByRange(*place).sortWithinPartitions(*place).select("ids", "ws", "n", "low", "ends")
    rows = materialise(dealt.mapInArrow(_tries, NODE_SCHEMA), "nodes")
    shared = materialise(merged(rows.where("digest is not null")), "merged")
    parents = shared.select(F.col("digest").alias("up"), F.col("low").alias("up_low"), F.col("children").alias("copies"))
    columns = ["up", "low", "depth", "n", "children", "leaves", "saved", "ends"]
    below = rows.where("digest is null and up is not null").select(*columns).unionByName(shared.where("up is not null").select(*columns))
    met = join_spread(below, parents, ["up"], shared.agg(F.coalesce(F.sum("children"), F.lit(0))).first()[0])
    out = met.withColumnRenamed("up_low", "parent_low").drop("up")
    out = out.unionByName(rows.where("digest is null and up is null").select(*out.columns))
    out = out.unionByName(shared.where("up is null").withColumn("parent_low", F.lit(None).cast("long")).select(*out.columns))
    names = [("low", "conv_id"), ("depth", "depth"), ("parent_low", "parent_conv_id"), ("n", "n_convs"), ("children", "n_children"), ("leaves", "n_leaves"), ("saved", "saved_tokens")]
    return out.select(*[F.col(a).cast("long").alias(b) for a, b in names], F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of rebuilt conversations, a row for each node: see trie_nodes().

    conversations has conv_id, turn, role and text; other columns are ignored. A null turn comes first, a null role or
    text is empty, turns of one place are ordered by the digest of role and text, repeated rows are turns of their own,
    and rows of a null conv_id are left out. An empty table has no node, not even a root. The numbers of a conversation's
    turns (16 bytes a turn) are one row; its texts are not.
    """
    return trie_nodes(sequences(rebuilt(encoded_turns(conversations))))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = rf"""
WITH RECURSIVE {CRC32_SQL},
t AS (SELECT conv_id, turn, sha256(length(role)::VARCHAR || ':' || role || text) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list({{'k': k, 'w': w}} ORDER BY turn NULLS FIRST, k) AS s FROM t GROUP BY conv_id),
hashed AS (SELECT conv_id, s, {crc32_sql("hx")} % 4 AS h FROM (SELECT *, hex(encode(conv_id::VARCHAR)) AS hx FROM own), crc_table),
r AS (SELECT a.conv_id, list_concat(coalesce(b.s[1:h], []), a.s[h + 1:]) AS s FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
p AS (SELECT conv_id, d, len(s) AS size, CASE WHEN d = 0 THEN 0 ELSE s[d].w END AS w, md5(array_to_string(list_transform(s[1:d], lambda x: x.k), ',')) AS key
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM r)),
node AS (SELECT d, key, min(conv_id) AS low, count(*) AS n, any_value(w) AS w, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d) AS ends FROM p GROUP BY d, key),
parent AS (SELECT node.*, p.key AS up FROM node LEFT JOIN p ON p.conv_id = low AND p.d = node.d - 1),
kids AS (SELECT d - 1 AS d, up AS key, count(*) AS children FROM parent WHERE up IS NOT NULL GROUP BY ALL),
full_node AS (SELECT parent.*, coalesce(children, 0) AS children FROM parent LEFT JOIN kids USING (d, key)),
below AS (SELECT p.d, p.key, sum((f.children = 0)::INT) AS leaves, sum((f.n - 1) * f.w) AS saved FROM full_node f JOIN p ON p.conv_id = f.low AND p.d <= f.d GROUP BY ALL)
SELECT f.low AS conv_id, f.d::BIGINT AS depth, g.low AS parent_conv_id, f.n::BIGINT AS n_convs, f.children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_node f JOIN below USING (d, key) LEFT JOIN node g ON g.d = f.d - 1 AND g.key = f.up
"""
