"""Names for blank nodes that follow from the graph alone, so that graphs which differ only in labels come out equal.

Blank nodes are placed by the lines of their triples, themselves and other blank nodes left unnamed. Where that ties, colours are refined:
each round a node's colour takes in those of its neighbours, as a sum of hashes that combines before its shuffle, until no more are told apart. Blank nodes
that triples join are a component. Only components in which nodes still tie go to a task as a whole: there each of the nodes of the first tie is set apart in
turn, refinement goes on, and the least outcome counts; nodes that can change places without changing a triple are tried once.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattix.operators.order import weak_components
from lattix.operators.shared import Scratch, numbered

#: So many of a node's lines, the least, place it before colours do.
LINES = 64
TRIPLE = ("s", "p", "o", "kind", "datatype", "lang")


def _text(term: str, blank: str) -> Column:
    return F.when(F.col(blank), "_:").otherwise(F.concat(F.lit("<"), term, F.lit(">")))


def _object() -> Column:
    literal = F.concat(F.lit('"'), "o", F.lit('"@'), F.coalesce("lang", F.lit("")), F.lit("^^"), F.coalesce("datatype", F.lit("")))
    return F.when(F.col("kind") == "literal", literal).otherwise(_text("o", "o_blank"))


def _sides(triples: DataFrame) -> DataFrame:
    """(node, role, p, other, text, line): each triple from the side of each blank node in it; other is the blank node at its other end, if there is one and it isn't the same."""
    own = triples.withColumn("s_blank", F.col("s").startswith("_:")).withColumn("o_blank", F.col("kind") == "blank")
    same = F.col("o_blank") & (F.col("s") == F.col("o"))
    p = F.concat(F.lit(" <"), "p", F.lit("> "))
    star = F.lit("_:*")
    subject = own.where("s_blank").select(F.col("s").alias("node"), F.when(same, "both").otherwise("s").alias("role"), "p", F.when(F.col("o_blank") & ~same, F.col("o")).alias("other"), _object().alias("text"), F.concat(star, p, F.when(same, star).otherwise(_object())).alias("line"))
    object_ = own.where(F.col("o_blank") & ~same).select(F.col("o").alias("node"), F.lit("o").alias("role"), "p", F.when(F.col("s_blank"), F.col("s")).alias("other"), _text("s", "s_blank").alias("text"), F.concat(_text("s", "s_blank"), p, star).alias("line"))
    return subject.union(object_)


def _summed(value: Column) -> Column:
    return F.sum(value.cast("decimal(20,0)")).cast("string")


def refine(colours: dict, sides: dict) -> dict:
    """Ranks of nodes, told apart by their neighbours as far as that goes. sides has for each node its (role, p, other or None, text)."""
    while True:
        told = {v: (c, sorted((role, p, "" if other is None else f"{colours[other]:09d}", text) for role, p, other, text in sides[v])) for v, c in colours.items()}
        place = {k: i for i, k in enumerate(sorted({(c, tuple(x)) for c, x in told.values()}))}
        new = {v: place[c, tuple(x)] for v, (c, x) in told.items()}
        if len(place) == len(set(colours.values())):
            return new
        colours = new


def swaps(u: str, v: str, sides: dict) -> bool:
    """Whether u and v can change places without changing a triple."""
    turned = {u: v, v: u}
    moved = lambda x: sorted((role, p, turned.get(other, other) or "", text) for role, p, other, text in sides[x])
    plain = lambda x: sorted((role, p, other or "", text) for role, p, other, text in sides[x])
    return moved(u) == plain(v)


def canonical_order(colours: dict, sides: dict) -> tuple[list, list]:
    """(lines, nodes): nodes in an order that labels don't change, and the triples written with places in it, the least of all outcomes."""
    ranks = refine(colours, sides)
    cells: dict = {}
    for v, c in ranks.items():
        cells.setdefault(c, []).append(v)
    tied = next((cells[c] for c in sorted(cells) if len(cells[c]) > 1), None)
    if tied is None:
        order = sorted(ranks, key=ranks.get)
        at = {v: i for i, v in enumerate(order)}
        return sorted((at[v], role, p, -1 if other is None else at[other], text) for v in order for role, p, other, text in sides[v]), order
    tried, best = [], None
    for v in tied:
        if any(swaps(u, v, sides) for u in tried):
            continue
        tried.append(v)
        found = canonical_order({x: 2 * c + (x != v and c == ranks[v]) for x, c in ranks.items()}, sides)
        best = found if best is None or found[0] < best[0] else best
    return best


def _searched(rows: pd.DataFrame) -> pd.DataFrame:
    rank = {c: i for i, c in enumerate(sorted(set(rows["colour"])))}
    sides: dict = {}
    for node, role, p, other, text in zip(rows["node"], rows["role"], rows["p"], rows["other"], rows["text"], strict=True):
        sides.setdefault(node, []).append((role, p, None if pd.isna(other) else other, text))
    lines, order = canonical_order({v: rank[c] for v, c in zip(rows["node"], rows["colour"], strict=True)}, sides)
    return pd.DataFrame({"node": order, "at": range(len(order)), "form": hashlib.sha256(repr(lines).encode()).hexdigest()})


def blank_names(triples: DataFrame) -> DataFrame:
    """(node, name): each blank node of triples (s, p, o, kind, datatype, lang) with its name, _:b0, _:b1 and so on.

    Blank nodes are subjects that begin with _: and objects of kind blank. The order is that of the sorted lines of a node's triples, then of refined colours, then of components; equal components
    may have either order, which changes no line of the renamed graph.
    """
    scratch = Scratch(triples.sparkSession)
    cut = scratch.cut
    sides = cut(_sides(triples.select(*TRIPLE).distinct()))
    least = sides.select("node", "line", F.row_number().over(Window.partitionBy("node").orderBy("line")).alias("n")).where(F.col("n") <= LINES)
    lines = least.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))  # LINES at most
    every = sides.groupBy("node").agg(_summed(F.xxhash64("line")).alias("sum"))
    nodes = cut(lines.join(every, "node").withColumn("colour", F.xxhash64("lines", "sum")))
    count = nodes.select("colour").distinct().count()
    while True:
        known = nodes.select(F.col("node").alias("other"), F.col("colour").alias("other_colour"))
        near = sides.join(known, "other", "left").groupBy("node").agg(_summed(F.xxhash64("role", "p", "text", F.coalesce("other_colour", F.lit(0)))).alias("near"))
        finer = cut(nodes.join(near, "node").select("node", "lines", F.xxhash64("colour", "near").alias("colour")))
        if (now := finer.select("colour").distinct().count()) == count:
            break
        nodes, count = finer, now
    joined = weak_components(sides.where("other is not null").select(F.col("node").alias("source"), F.col("other").alias("target")))
    nodes = cut(nodes.select("node", "lines", "colour").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    kinds = nodes.groupBy("component").agg(_summed(F.xxhash64("colour")).alias("shape"), (F.count("*") > F.countDistinct("colour")).alias("tied"))
    nodes = cut(nodes.join(kinds, "component"))
    open_ = sides.join(nodes.where("tied").select("node", "component", "colour"), "node").select("component", "node", "colour", "role", "p", "other", "text")
    found = cut(open_.groupBy("component").applyInPandas(_searched, "node string, at long, form string"))
    placed = nodes.join(found, "node", "left").select("node", "lines", "colour", "shape", F.coalesce("form", F.lit("")).alias("form"), "component", F.coalesce("at", F.lit(0)).alias("at"))
    named = numbered(placed, "lines", "colour", "shape", "form", "component", "at")
    return scratch.result(named.select("node", F.concat(F.lit("_:b"), F.col("number").cast("string")).alias("name")))


def canonical(triples: DataFrame) -> DataFrame:
    """The triples (s, p, o, kind, datatype, lang), each once, with their blank nodes named by blank_names()."""
    own = triples.select(*TRIPLE).distinct()
    names = blank_names(own)
    at_s, at_o = names.toDF("s", "s_name"), names.toDF("o", "o_name").withColumn("kind", F.lit("blank"))
    return own.join(at_s, "s", "left").join(at_o, ["o", "kind"], "left").select(F.coalesce("s_name", "s").alias("s"), "p", F.coalesce("o_name", "o").alias("o"), "kind", "datatype", "lang")
