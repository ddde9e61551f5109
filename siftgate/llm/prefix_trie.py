"""Conversation prefix trie: which first turns conversations share, and the text that a cache of shared prefixes saves.

A conversation is the list of its turns by turn number (null first; equal numbers by role, then text digest). A turn is told by the SHA-256
of role and text, so texts are read once and never shuffled. Conversations with the same turns are one path with a count.

Paths are dealt out by the digest of their first turn to buckets, in each of which a task builds pointer dictionary
tries: nodes with dictionaries from turn digests to children, summed up from the leaves by an iterative postorder.
A first turn whose paths hold more than ``LIMIT`` turns is oversized: its node stays *open*, and its paths are dealt out again by the next turn, and so on.
The turns that all paths of an oversized group share (those that its least and its greatest path share) are opened at once, so that a long common
beginning costs one round and not one for each turn. Open nodes are summed by aggregates: leaves and savings of the closed
subtries count for each open node above. So a task holds a few times ``LIMIT`` turns at most, whatever share of all conversations one beginning has.
The digests of one conversation are a row; that is the only bound that is asked of the data.

The ids that end at a node are hashed as one string, which one task has to do; it reads them sorted, as a stream, in constant memory.

Cases: null roles and texts are empty; rows without conv_id belong to no conversation and are left out; repeated rows are turns of
their own; very long texts are hashed whole; other columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Turns of the paths that a task builds a trie of (about).
LIMIT = 200_000
#: Of the query: conversations come in series of ``SERIES``, of which the first lends up to ``LENT`` - 1 turns.
SERIES, LENT = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, path``: per conversation the digests and text bytes of its turns, in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    t = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), d.alias("d"), F.octet_length(text).cast("long").alias("b")).alias("t"))
    return t.groupBy("conv_id").agg(F.expr("transform(array_sort(collect_list(t), (x, y) -> CASE WHEN x.turn IS NULL AND y.turn IS NULL OR x.turn = y.turn THEN CASE WHEN struct(x.role, x.d) < struct(y.role, y.d) THEN -1 WHEN struct(x.role, x.d) > struct(y.role, y.d) THEN 1 ELSE 0 END WHEN x.turn IS NULL OR x.turn < y.turn THEN -1 ELSE 1 END), x -> struct(x.d, x.b))").alias("path"))


def rebuilt(each: DataFrame, series: int = SERIES, lent: int = LENT) -> DataFrame:
    """:func:`paths` with the first h turns of each conversation replaced by those of the first of its series, where h is a
    checksum of its id modulo ``lent``."""
    first = each.select(F.col("conv_id").alias("lender"), F.slice("path", 1, max(1, lent - 1)).alias("head"))
    own = each.withColumn("lender", F.expr(f"conv_id - conv_id % {series}")).withColumn("h", F.expr(f"CAST(crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {lent} AS INT)"))
    back = own.join(first, "lender", "left")
    return back.select("conv_id", F.expr("concat(coalesce(slice(head, 1, h), array()), slice(path, h + 1, greatest(size(path) - h, 0)))").alias("path"))


ENDS = "key string, ends string"


def _ends(batches):
    """Checksums of the ids of each key; rows come sorted by key and id."""
    now, sha = None, None
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = []
        for key, c in zip(keys, ids, strict=True):
            if key != now:
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(b"%d" % c)
            else:
                sha.update(b",%d" % c)
        yield pa.record_batch([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["key", "ends"])
    if now is not None:
        yield pa.record_batch([pa.array([now]), pa.array([sha.hexdigest()])], ["key", "ends"])


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
NODES = "top string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, key string"


def _tries(bucket: pd.DataFrame) -> pd.DataFrame:
    """The nodes of all tries of a bucket. A trie has the paths of one ``top``, from the node at depth ``k`` down."""
    depth, parent, least, convs, size, key, top = [], [], [], [], [], [], []
    child: list[dict] = []
    roots: dict = {}

    def node(d, p, b, t):
        depth.append(d)
        parent.append(p)
        size.append(b)
        top.append(t)
        least.append(np.iinfo(np.int64).max)
        convs.append(0)
        key.append(None)
        child.append({})
        return len(depth) - 1

    for t, k, digests, sizes, n, lowest, path_key in zip(*(bucket[c] for c in ("top", "k", "digests", "sizes", "n", "least", "key")), strict=True):
        at = roots.get(t)
        if at is None:
            at = roots[t] = node(k, -1, int(sizes[k - 1]), t)
        for i in range(k, len(digests) + 1):
            if i > k:
                below = child[at].get(digests[i - 1])
                if below is None:
                    below = child[at][digests[i - 1]] = node(i, at, int(sizes[i - 1]), t)
                at = below
            convs[at] += n
            least[at] = min(least[at], lowest)
        key[at] = path_key
    leaves = [0 if c else 1 for c in child]
    saved = [(n - 1) * b for n, b in zip(convs, size, strict=True)]
    for i in range(len(depth) - 1, -1, -1):  # children have larger numbers than their parents: a postorder without recursion
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    up = [least[p] if p >= 0 else None for p in parent]
    return pd.DataFrame({"top": top, "depth": depth, "conv_id": least, "parent_conv_id": pd.array(up, "Int64"), "n_convs": convs, "n_children": [len(c) for c in child], "n_leaves": leaves, "saved_tokens": saved, "key": pd.array(key, "string")})


def trie(convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of ``convs(conv_id, path)``: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``."""
    key = F.sha2(F.concat_ws("", F.col("path.d")), 256).alias("key")
    convs = C.table(convs.select("conv_id", "path", key), "rebuilt")
    n_parts = C.parts(convs.sparkSession)
    ends = C.table(convs.select("key", "conv_id").repartition(n_parts, "key").sortWithinPartitions("key", "conv_id").mapInArrow(_ends, ENDS), "ends")
    rows = C.table(convs.groupBy("key", "path").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).select("key", "path", "n", "least", F.lit("").alias("top"), F.lit(0).alias("k"), F.expr("CAST(array() AS array<struct<id:bigint,low:int,high:int>>)").alias("above")), "paths")
    C.drop(convs)

    closed, opened = [], []
    while True:
        # least and greatest path of a group share what all its paths share
        g = rows.groupBy("top").agg(F.sum(F.size("path")).alias("turns"), F.min("path").alias("lo"), F.max("path").alias("hi"), F.sum("n").alias("n_convs"), F.min("least").alias("id"), F.first("k").alias("k"), F.first("above").alias("above"))
        big = g.where(F.col("turns").__gt__(limit) | (F.col("k") == 0))
        shared = F.expr("coalesce(array_position(zip_with(lo, hi, (a, b) -> a <=> b), false) - 1, size(lo))")
        shared = F.when(shared < 0, F.size("lo")).otherwise(shared).cast("int")
        big = C.table(big.withColumn("high", shared), "open")
        if not big.count():
            closed.append(rows)
            break
        closed.append(C.table(rows.join(big.select("top"), "top", "left_anti"), "closed"))
        # a path that ends at the branching node is that node's own
        ending = rows.join(big.select("top", "high"), "top").where("size(path) = high").select("top", F.col("key").alias("ended"))
        opened.append(C.table(big.join(ending, "top", "left"), "opened"))
        down = rows.drop("above", "k").join(big.select("top", F.col("id").alias("at"), F.col("k").alias("low"), "high", "above"), "top").where("size(path) > high")
        down = down.select("key", "path", "n", "least", F.expr("concat(at, ':', high, ':', get(path, high).d)").alias("top"), F.expr("high + 1").alias("k"), F.expr("concat(above, array(struct(at AS id, low, high)))").alias("above"))
        before, rows = rows, C.table(down, "paths")
        C.drop(before, big)

    if not opened:  # no conversation, no root
        return convs.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string")
    small = _union(closed)
    total = small.agg(F.sum(F.size("path"))).first()[0] or 0
    buckets = max(n_parts, -(-total // limit))
    dealt = small.select("top", "k", F.col("path.d").alias("digests"), F.col("path.b").alias("sizes"), "n", "least", "key", F.pmod(F.xxhash64("top"), F.lit(buckets)).alias("bucket"))
    nodes = C.table(dealt.groupBy("bucket").applyInPandas(_tries, NODES), "tries")

    # open nodes: one row for each depth between two branchings
    spots = _union(opened).select("n_convs", "id", "lo", "above", F.col("high").alias("branch"), "ended", F.explode(F.expr("sequence(k, high)")).alias("depth"), F.col("k").alias("low"))
    node = F.struct("id", "depth").alias("node")
    spots = C.table(spots.select(node, "n_convs", F.expr("coalesce(get(lo, depth - 1).b, 0L)").alias("b"), F.expr("filter(concat(above, array(struct(id, low, depth AS high))), x -> x.low <= x.high)").alias("above"), F.when(F.col("depth") == F.col("branch"), F.col("ended")).alias("key"), (F.col("depth") < F.col("branch")).alias("inner")), "spots")
    # whatever counts for the open nodes above: closed tries by their tops, open nodes by themselves
    tops = nodes.where("parent_conv_id IS NULL").select("top", "n_leaves", "saved_tokens").join(small.groupBy("top").agg(F.first("above").alias("above")), "top")
    tops = C.table(tops, "tops")
    each = F.expr("flatten(transform(above, x -> transform(sequence(x.low, x.high), d -> struct(x.id, d AS depth))))")
    # an open node without anything below is a leaf
    parents = tops.select(F.expr("get(above, size(above) - 1)").alias("p")).select(F.struct("p.id", F.col("p.high").alias("depth")).alias("node"))
    nested = spots.where("size(above) > 1 AND node.depth = get(above, size(above) - 1).low").select(F.expr("get(above, size(above) - 2)").alias("p")).select(F.struct("p.id", F.col("p.high").alias("depth")).alias("node"))
    below = parents.unionByName(nested).groupBy("node").agg(F.count("*").alias("n"))
    spots = C.table(spots.join(below, "node", "left").withColumn("n_children", F.when(F.col("inner"), 1).otherwise(F.coalesce("n", F.lit(0)))), "counted")
    gains = tops.select(F.explode(each).alias("node"), "n_leaves", F.col("saved_tokens").alias("saved"))
    gains = gains.unionByName(spots.select(F.explode(each).alias("node"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("b")).alias("saved")))
    sums = gains.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    up = F.expr("CASE WHEN node.depth > get(above, size(above) - 1).low THEN node.id WHEN size(above) > 1 THEN get(above, size(above) - 2).id END")
    top_rows = spots.join(sums, "node").select("node.id", F.col("node.depth").cast("long").alias("depth"), up.alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", "key").withColumnRenamed("id", "conv_id")
    hung = nodes.join(tops.select("top", F.expr("get(above, size(above) - 1).id").alias("hook")), "top").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "hook"))
    every = hung.select(*top_rows.columns).unionByName(top_rows)
    return every.join(ends, "key", "left").select(*NODE, F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(paths(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP13_SQL = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc(conv_id, s, i, bit, v) AS (
 SELECT conv_id, conv_id::VARCHAR, 1, 0, 4294967295::BIGINT FROM ids
 UNION ALL
 SELECT conv_id, s, CASE WHEN bit = 7 THEN i + 1 ELSE i END, (bit + 1) % 8,
  CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
 FROM (SELECT conv_id, s, i, bit, CASE WHEN bit = 0 THEN xor(v, ascii(s[i])::BIGINT) ELSE v END AS x FROM crc WHERE i <= length(s))),
h AS (SELECT conv_id, xor(v, 4294967295::BIGINT) % 9 AS h FROM crc WHERE i > length(s)),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
  sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT h.conv_id, t.i, t.d, t.b FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 AND t.i <= h.h
 UNION ALL SELECT h.conv_id, t.i + 100, t.d, t.b FROM h JOIN t USING (conv_id) WHERE t.i > h.h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth, d, b FROM r),
c AS (SELECT conv_id, depth, b, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM o
 UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
l AS (SELECT conv_id, max(depth) AS last FROM c GROUP BY ALL),
n AS (SELECT path, any_value(depth) AS depth, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends FROM c JOIN l USING (conv_id) GROUP BY path),
k AS (SELECT left(path, -64) AS up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.path),
s AS (SELECT left(m.path, (64 * g.d)::INTEGER) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * b)::BIGINT AS saved
 FROM m, LATERAL (SELECT unnest(range(0, depth + 1)) AS d) g GROUP BY 1)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN s USING (path) LEFT JOIN n p ON m.depth > 0 AND p.path = left(m.path, -64)
"""
