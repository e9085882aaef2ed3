"""The trie of conversations by their turns, by prefix doubling.

Turns with the same role and text get one number. Blocks of 2^k turns are named by the names of their halves, those of all conversations at once: equal
pairs get one dense number, in one join for each k. A prefix of d turns is made of the blocks that the binary digits of d ask for, the
largest first, so prefixes are named in as many rounds again, from a shorter prefix and a block. Prefixes of equal depth and name are one node.

What a node says of its subtree is summed by doubling as well: each node adds what it knows of the depths below to its ancestor
2^k levels up. Nothing is gathered by conversation or by node but counts, sums and minima, which combine before their shuffle; however
long a conversation and however many share it, rows are dealt by pairs of names or by places, and joins on frequent ones can be split. The only exception is the digest
of a node's conversation ids, one hash over one ordered text: ids are joined into pieces in parallel, and only the pieces of a node meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.llm.scratch import drop_since, made, numbered, written

#: Up to so many rows are sent to every executor.
BROADCAST_ROWS = 200_000
#: Ids of a node that one piece of its list joins.
PIECE = 4096


def small(rows: DataFrame, count: int) -> DataFrame:
    """For a join: sent to all executors if that is few rows, else shuffled."""
    return F.broadcast(rows) if count <= BROADCAST_ROWS else rows


def ordered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, role, text): the turns of each conversation from 0 on, in the order of turn, null first, ties by role and text.

    Null roles and texts become empty; turns of no conversation (null) are left out. Rows are dealt by ranges of conversation and turn and numbered as they lie, so a
    long conversation spreads over tasks.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    blank = {c: F.coalesce(F.col(x).cast("string"), F.lit("")).alias(c) for c, x in (("role", role_col), ("text", text_col))}
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), *blank.values()).where("conv_id is not null")
    lines, _ = numbered(turns.repartitionByRange(*order).sortWithinPartitions(*order), "turns")
    first = lines.groupBy("conv_id").agg(F.min("number").alias("first"))
    return lines.join(first, "conv_id").select("conv_id", (F.col("number") - F.col("first")).alias("pos"), "role", "text")


def named(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows with name, a dense number of the contents of keys, in place of these."""
    names, count = numbered(rows.select(*keys).distinct(), "names")
    names = names.withColumnRenamed("number", "name")
    bounded = all(kind == "bigint" for c, kind in rows.dtypes if c in keys)  # texts can be of any size
    return rows.join(small(names, count) if bounded else names, list(keys)).drop(*keys)


def prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """(conv_id, depth, name) of all prefixes with a turn. At equal depth, names are equal if and only if prefixes are.

    turns has (conv_id, pos, role, text), pos from 0 on without gaps; no conversation has more than longest turns.
    """
    blocks = [written(named(turns, "role", "text"), "blocks")]  # (conv_id, pos, name), pos in blocks of 2^k
    half = F.col("pos") % 2
    for _ in range(1, longest.bit_length()):
        pairs = blocks[-1].groupBy("conv_id", F.floor(F.col("pos") / 2).cast("long").alias("pos")).agg(F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right"))
        blocks.append(written(named(written(pairs.where("right is not null"), "pairs"), "left", "right"), "blocks"))
    # a depth with one binary digit is a first block; others add the block of their least digit to a prefix with one digit less
    rounds = [_union([b.where("pos = 0").select("conv_id", F.lit(1 << k).cast("long").alias("depth"), "name") for k, b in enumerate(blocks)])]
    parts = _union([b.where("pos > 0").select("conv_id", (F.col("pos") * (1 << k)).alias("depth"), F.lit(1 << k).cast("long").alias("size"), F.col("name").alias("right")) for k, b in enumerate(blocks)])
    parts = parts.where("depth % (2 * size) = 0")
    for digits in range(2, longest.bit_length() + 1):
        longer = parts.where(F.bit_count("depth") == digits - 1).join(rounds[-1].withColumnRenamed("name", "left"), ["conv_id", "depth"])
        longer = written(longer.select("conv_id", (F.col("depth") + F.col("size")).alias("depth"), "left", "size", "right"), "longer")
        rounds.append(written(named(longer, "left", "size", "right").select("conv_id", "depth", "name"), "prefixes"))
    return _union(rounds)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def subtree_sums(nodes: DataFrame, columns: list[str], deepest: int) -> DataFrame:
    """nodes (node, parent, and columns of numbers) with each column summed over the node and all below it; no node is more than deepest levels below another."""
    sums = nodes.select("node", *columns)
    up = nodes.where("parent is not null").select("node", F.col("parent").alias("to"))  # to the ancestor 2^k levels up
    for k in range(deepest.bit_length()):
        if k:
            up = written(up.join(up.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")), "up")
        gain = up.join(sums, "node").groupBy(F.col("to").alias("node")).agg(*(F.sum(c).alias(f"{c}_more") for c in columns))
        sums = written(sums.join(gain, "node", "left").select("node", *((F.col(c) + F.coalesce(f"{c}_more", F.lit(0))).alias(c) for c in columns)), "sums")
    return sums


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which come one after the other."""
    node, state = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])
    for batch in batches:
        for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != node:
                if state:
                    yield out()
                node, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
    if state:
        yield out()


def id_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ends (node, conv_id): SHA-256 of a node's ids in ascending order, joined by commas."""
    lines, _ = numbered(ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id"), "ends")
    piece = F.floor(F.col("number") / PIECE).alias("piece")
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))  # PIECE of them at most
    pieces = lines.groupBy("node", piece).agg(F.concat_ws(",", ids).alias("ids"))
    return pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids").mapInArrow(_digests, "node long, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Per node: conv_id (its smallest member), depth, parent_conv_id (its parent's conv_id, null for the root), n_convs (members), n_children, n_leaves (nodes without children in its
    subtree), saved_tokens (over its subtree, members less one times the length of the last text) and ends_sha256 (of the ids of members that end there).

    turns has (conv_id, pos, role, text), pos from 0 on without gaps; conversations has conv_id, those without a turn included, and is that of turns if not given.
    Equal conversations are members of the same nodes; without any conversation there are no nodes. The root has no text and depth 0.
    """
    spark, start = turns.sparkSession, made()
    turns = written(turns.select("conv_id", "pos", "role", "text"), "turns")
    everyone = written((turns if conversations is None else conversations).select("conv_id").where("conv_id is not null").distinct(), "everyone")
    longest = (turns.agg(F.max("pos")).first()[0] or 0) + 1
    found = prefixes(turns, longest)
    size = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), F.length("text").cast("long").alias("size"))
    root = everyone.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("size"))
    member = written(found.join(size, ["conv_id", "depth"]).select(*root.columns).union(root), "members")
    grouped = member.groupBy("depth", "name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"))
    nodes, count = numbered(grouped, "nodes")
    nodes = nodes.withColumnRenamed("number", "node")
    ids = nodes.select("depth", "name", "node")
    # the smallest member also passes through the parent
    above = member.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent_name"))
    parent = nodes.select("conv_id", "depth", "node").join(above, ["conv_id", "depth"]).select("node", (F.col("depth") - 1).alias("depth"), F.col("parent_name").alias("name"))
    parent = written(parent.join(small(ids.withColumnRenamed("node", "parent"), count), ["depth", "name"]).select("node", "parent"), "parents")
    children = parent.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    own = nodes.join(parent, "node", "left").join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = written(own.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("size")), "own")
    sums = subtree_sums(own.select("node", "parent", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"], longest)
    last = member.groupBy("conv_id").agg(F.max("depth").alias("depth")).join(member, ["conv_id", "depth"]).join(small(ids, count), ["depth", "name"])
    digests = id_digests(last.select("node", "conv_id"))
    up = own.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    table = own.drop("n_leaves", "saved_tokens").join(sums, "node").join(digests, "node", "left").join(up, "parent", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")]
    out = written(table.select(*columns), "trie")
    drop_since(spark, start, out)
    return out


def branched(conversations: DataFrame, every: int, shared: Column, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another: of conversation c, the first turns are those of c - c % every, as many as shared says (a column of conv_id), then come its own beyond as many.

    Gives the turns for trie(), and the ids of all conversations, those left without a turn included. The head is as short as the other conversation if that is shorter, and empty if there is none.
    """
    turns = written(ordered(conversations, **columns), "ordered")
    ids = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("__head", shared.cast("long")).withColumn("__base", F.col("conv_id") - F.col("conv_id") % every), "ids")
    count, most = ids.agg(F.count("*"), F.coalesce(F.max("__head"), F.lit(0))).first()
    head = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "__base")
    begun = ids.select("conv_id", "__base", "__head").join(head, "__base").where("pos < __head").select("conv_id", "pos", "role", "text")
    length = ids.select(F.col("conv_id").alias("__base"), F.col("n").alias("__n"))
    moved = ids.join(length, "__base", "left").select("conv_id", "__head", (F.least("__head", F.coalesce("__n", F.lit(0))) - F.col("__head")).alias("__shift"))
    rest = turns.join(small(moved, count), "conv_id").where("pos >= __head").select("conv_id", (F.col("pos") + F.col("__shift")).alias("pos"), "role", "text")
    return begun.unionByName(rest), ids.select("conv_id")
