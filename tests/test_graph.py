import random
import time

import pytest
from pyspark.sql import functions as F

from lattix.operators import compose, graph, links


def brute_reach(edges):
    out = {}
    for s in {a for a, _ in edges}:
        seen, depth, frontier = {}, 0, {s}
        while frontier:
            depth += 1
            frontier = {b for a, b in edges if a in frontier} - set(seen)
            seen |= {x: depth for x in frontier}
        out |= {(s, x): d for x, d in seen.items()}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_reach_depth_and_cycles(spark, seed):
    r = random.Random(seed)
    edges = {(r.randrange(12), r.randrange(12)) for _ in range(16)}
    df = spark.createDataFrame([*edges, *list(edges)[:3], (None, 1), (2, None)], "source long, target long")
    want = brute_reach(edges)
    assert {(x.source, x.target): x.depth for x in graph.reach(df).collect()} == want
    starts = spark.createDataFrame([(3,), (3,), (5,), (99,)], "source long")
    assert {(x.source, x.target): x.depth for x in graph.reach(df, starts=starts).collect()} == {k: v for k, v in want.items() if k[0] in (3, 5)}
    assert {x.node for x in graph.cycle_nodes(df).collect()} == {a for a, b in want if a == b}


def test_proofs_take_the_least_of_the_shortest(spark):
    df = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e")], "source string, target string")
    got = {(x.source, x.target): x.path for x in graph.proofs(df).collect()}
    assert got == {("a", "d"): ["a", "b", "d"], ("a", "e"): ["a", "b", "d", "e"], ("b", "e"): ["b", "d", "e"], ("c", "e"): ["c", "d", "e"]}


def test_layers_leave_cycles_open(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x")], "source string, target string")
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "node string")
    assert {x.node: x.layer for x in graph.layers(edges, nodes).collect()} == {"c": 0, "b": 1, "a": 2, "x": None, "y": None, "z": None}


def test_empty_edges(spark):
    none = spark.createDataFrame([], "source string, target string")
    assert graph.reach(none).count() == graph.cycle_nodes(none).count() == graph.proofs(none).count() == 0
    assert links.resolve(spark.createDataFrame([], "source string, key string, target string")).count() == 0


def test_resolve_prefers_authored(spark):
    df = spark.createDataFrame([("a", "requires", "b"), ("b", "required-by", "a"), ("a", "excludes", "c")], "source string, key string, target string")
    got = {(x.source, x.key, x.target): x.computed for x in links.resolve(df).collect()}
    assert got == {("a", "requires", "b"): False, ("b", "required-by", "a"): False, ("a", "excludes", "c"): False, ("c", "excludes", "a"): True}


def test_compose_steps_run_once(spark):
    e = lambda *rows: spark.createDataFrame(list(rows), "source string, target string")
    chosen = spark.createDataFrame([("a",), ("n",)], "slug string")
    row = compose.verdict(chosen, e(("a", "b"), ("b", "c")), e(("n", "c")), e(("a", "b"), ("a", "c")), e(("b", "q"), ("c", "w"))).first()
    assert (row.n_selected, row.n_added, row.n_hidden, row.n_members, row.n_conflicts, row.n_warnings, row.valid) == (2, 2, 1, 3, 1, 1, False)
    assert compose.closure(chosen, e(("a", "b"))).where(F.col("added")).first().slug == "b"


def test_reach_along_forests_cycles_and_keys(spark, monkeypatch):
    r = random.Random(5)
    cases = [
        [("a", i, i - 1) for i in range(1, 40)] + [("b", i, i // 2) for i in range(1, 20)], [("a", i, (i + 1) % 13) for i in range(13)] + [("a", i + 100, i + 99) for i in range(1, 20)] + [("a", 100, 3)],
        [(k, r.randrange(25), r.randrange(25)) for k in "aab" for _ in range(30)] + [("a", None, 1)], [("a", 1, None)],
    ]
    for edges in cases:
        want = {}
        for k, s in {(k, s) for k, s, _ in edges}:
            frontier, depth, seen = {s}, 0, {}
            while frontier := {t for a, x, t in edges if a == k and x in frontier and None not in (x, t)} - set(seen):
                depth += 1
                seen |= dict.fromkeys(frontier, depth)
            want |= {(k, s, t): d for t, d in seen.items()}
        for sent in (graph.SENT, 0):
            monkeypatch.setattr(graph, "SENT", sent)
            got = graph.reach(spark.createDataFrame(edges, "k string, source long, target long"), within="k").collect()
            assert {(x.k, x.source, x.target): x.depth for x in got} == want and len(got) == len(want)


def test_reach_joins_no_more_than_it_gives(spark):
    """Of a long chain each pair is met once; joining all known pairs with all makes more than a billion rows."""
    n, began = 2000, time.perf_counter()
    got = graph.reach(spark.range(1, n + 1).selectExpr("id AS source", "id - 1 AS target")).agg(F.count("*"), F.sum(F.abs(F.col("source") - F.col("target") - F.col("depth")))).first()
    assert tuple(got) == (n * (n + 1) // 2, 0) and time.perf_counter() - began < 60
