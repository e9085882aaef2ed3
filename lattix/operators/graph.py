"""Graph questions over edge tables: reach, proofs, cycles, depth, neighbours. Edges are (source, target) rows of any one type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattix.operators.shared import Scratch, cut

#: So many rows of jumps at most are broadcast; more are joined by a shuffle.
SENT = 1_000_000


def reach(edges: DataFrame, source: str = "source", target: str = "target", starts: DataFrame | None = None, within: str | None = None) -> DataFrame:
    """(source, target, depth): every pair that a path of one edge or more joins, with the least number of edges.

    From all sources, paths double each round, so the rounds are the logarithm of the longest, and in each only paths of just the length known go on. From a
    table of starts (column source), the frontier grows by an edge a round and never meets a pair again. Cycles end
    both; a node on one reaches itself. Null ends are ignored. within names a column of edges that is the same along a path and is given too; it goes without starts.
    """
    own = [within] if within else []
    base = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(*own, F.col(source).alias("source"), F.col(target).alias("target")).distinct()
    if starts is not None:
        return _reach_from(base, starts.select(F.col("source")).distinct())
    scratch = Scratch(edges.sparkSession)
    first = scratch.cut(base.withColumn("depth", F.lit(1)))
    if (ahead := _ahead(first, own, scratch.cut)) is not None:
        return _along(first, ahead, own, scratch)
    found, new, known = first, first, 1  # all pairs of up to so many edges, and those of them that are of the last round
    while not (ends := new.where(F.col("depth") == known)).isEmpty():  # a longer path begins with one of exactly so many
        pair = [*own, "source", "target"]
        new = scratch.cut(found.union(_onward(ends, found, own)).groupBy(*pair).agg(F.min("depth").alias("depth")).where(F.col("depth") > known))
        found, known = found.union(new), 2 * known
    return found


def _onward(ends: DataFrame, found: DataFrame, own: list[str]) -> DataFrame:
    onward = found.select(*own, F.col("source").alias("mid"), F.col("target").alias("end"), F.col("depth").alias("more"))
    return ends.withColumnRenamed("target", "mid").join(onward, [*own, "mid"]).select(*own, "source", F.col("end").alias("target"), (F.col("depth") + F.col("more")).alias("depth"))


def _ahead(first: DataFrame, own: list[str], cut) -> list[tuple[DataFrame, int]] | None:
    """Where 1, 2, 4 and so on edges lead from each source that has so many ahead, and how many have; None if a source has two targets or there is a cycle.

    Without a cycle, of those with so many edges ahead some have fewer than twice as many.
    """
    far, count = first.drop("depth"), first.count()
    if far.select(*own, "source").distinct().count() < count:
        return None
    ahead = []
    while count:
        ahead.append((far, count))
        onward = far.select(*own, F.col("source").alias("mid"), F.col("target").alias("end"))
        far = cut(far.withColumnRenamed("target", "mid").join(onward, [*own, "mid"]).select(*own, "source", F.col("end").alias("target")))
        if (now := far.count()) == count:
            return None
        count = now
    return ahead


def _along(first: DataFrame, ahead: list[tuple[DataFrame, int]], own: list[str], scratch: Scratch) -> DataFrame:
    """All pairs of a forest, each once: a depth is a sum of different powers of two, so from the longest jump on each is made or not."""
    small = sum(n for _, n in ahead) <= SENT
    parts = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = first.select(*own, "source", F.col("source").alias("target"), F.lit(0).alias("depth")).repartition(parts, *own, "source")  # a few rows become many
    for k, (far, _) in reversed(list(enumerate(ahead))):
        jump = far.select(*own, F.col("source").alias("target"), F.col("target").alias("next"))
        at = F.array(F.struct("target", "depth"), F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("target"), (F.col("depth") + 2**k).alias("depth"))))
        pairs = pairs.join(F.broadcast(jump) if small else jump, [*own, "target"], "left").select(*own, "source", F.explode(at).alias("at")).where("at is not null").select(*own, "source", "at.*")
    pairs = pairs.where("depth > 0")
    return pairs if small else scratch.result(pairs)


def _reach_from(base: DataFrame, starts: DataFrame) -> DataFrame:
    onward = base.select(F.col("source").alias("mid"), F.col("target").alias("end"))
    frontier = cut(base.join(starts, "source", "left_semi").withColumn("depth", F.lit(1)))
    found = frontier
    while not frontier.isEmpty():
        met = frontier.join(onward, F.col("target") == F.col("mid")).select("source", F.col("end").alias("target"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = cut(met.join(found.select("source", "target"), ["source", "target"], "left_anti"))
        found = found.union(frontier)  # of checkpoints, so what is known isn't written again
    return found


def walk(edges: DataFrame, starts: DataFrame, hops: int, fan_out: int | None = None) -> DataFrame:
    """(node, hop) of what starts (column node) reach in at most so many hops, with the least number; of each node only the first fan_out targets in order are followed."""
    base = edges.select("source", "target").dropna().distinct()
    if fan_out is not None:
        base = base.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("target"))).where(F.col("n") <= fan_out).select("source", "target")
    frontier = cut(starts.select("node").distinct().withColumn("hop", F.lit(0)))
    found = frontier
    for hop in range(1, hops + 1):
        met = frontier.join(base, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        frontier = cut(met.join(found.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        found = found.union(frontier)
    return found


def proofs(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(source, target, depth, path): the shortest chain of nodes of every pair that two edges or more join, the least in order of several."""
    base = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias("source"), F.col(target).alias("target")).distinct()
    best = cut(base.select("source", "target", F.struct(F.lit(1).alias("depth"), F.array("source", "target").alias("path")).alias("p")))
    known = 1
    while best.agg(F.max("p.depth")).first()[0] == known:
        onward = best.select(F.col("source").alias("mid"), F.col("target").alias("end"), F.col("p").alias("q"))
        joined = F.struct((F.col("p.depth") + F.col("q.depth")).alias("depth"), F.concat("p.path", F.slice("q.path", F.lit(2), F.size("q.path"))).alias("path"))
        longer = best.join(onward, F.col("target") == F.col("mid")).select("source", F.col("end").alias("target"), joined.alias("p")).where("source != target")
        best, known = cut(best.union(longer).groupBy("source", "target").agg(F.min("p").alias("p"))), 2 * known
    return best.where("p.depth >= 2").select("source", "target", "p.depth", "p.path")


def cycle_nodes(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Nodes that lie on a cycle. Nodes without a way in or out are peeled off first, so that reach is sought only in what is left."""
    rest = cut(edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias("source"), F.col(target).alias("target")).distinct())
    count = rest.count()
    while count:
        heads, tails = rest.select(F.col("source").alias("target")), rest.select(F.col("target").alias("source"))
        rest = cut(rest.join(heads.distinct(), "target", "left_semi").join(tails.distinct(), "source", "left_semi").select("source", "target"))
        if (now := rest.count()) == count:
            break
        count = now
    return reach(rest).where("source = target").select(F.col("source").alias("node"))


def inverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").union(inverse(edges)).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) of every node of an edge."""
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def neighbours(edges: DataFrame, node: object) -> DataFrame:
    """(neighbour, direction) of one node."""
    out = edges.where(F.col("source") == F.lit(node)).select(F.col("target").alias("neighbour"), F.lit("out").alias("direction"))
    return out.union(edges.where(F.col("target") == F.lit(node)).select(F.col("source").alias("neighbour"), F.lit("in").alias("direction"))).distinct()


def orphans(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Nodes that no edge touches."""
    ends = edges.select(F.col("source").alias(node)).union(edges.select(F.col("target").alias(node))).distinct()
    return nodes.join(ends, node, "left_anti")


def several_parents(edges: DataFrame) -> DataFrame:
    """(source, parents) of nodes with more than one target."""
    return edges.distinct().groupBy("source").agg(F.count("*").alias("parents")).where("parents > 1")


def depth_over(edges: DataFrame, limit: int) -> DataFrame:
    """(source, depth) of nodes that stand more than limit edges below a root."""
    return reach(edges).groupBy("source").agg(F.max("depth").alias("depth")).where(F.col("depth") > limit)


def layers(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """(node, layer): nodes in order of need, those that need nothing in layer 0; what hangs on a cycle has none."""
    need = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    left, done, layer = cut(nodes.select(F.col(node).alias("node")).distinct()), None, 0
    while True:
        open_ = need if done is None else need.join(done.select(F.col("node").alias("b")), "b", "left_anti")
        free = cut(left.join(open_.select(F.col("a").alias("node")), "node", "left_anti").withColumn("layer", F.lit(layer)))
        if free.isEmpty():
            rest = left.withColumn("layer", F.lit(None).cast("int"))
            return rest if done is None else done.union(rest)
        done = free if done is None else cut(done.union(free))
        left = cut(left.join(free.select("node"), "node", "left_anti"))
        layer += 1


def key(column: str, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))
