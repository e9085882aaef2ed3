"""Names of blank nodes against all permutations, in task code on many small graphs and through Spark on a few."""

import itertools
import random

from lattix.operators import blank_nodes

SCHEMA = "s string, p string, o string, kind string, datatype string, lang string"


def sides_of(edges, n):
    sides = {v: [] for v in range(n)}
    for s, p, o in edges:
        if s == o:
            sides[s].append(("both", p, None, ""))
        else:
            sides[s].append(("s", p, o, ""))
            sides[o].append(("o", p, s, ""))
    return {str(v): [(r, p, None if x is None else str(x), t) for r, p, x, t in rows] for v, rows in sides.items()}


def form(edges, n):
    return str(blank_nodes.canonical_order({str(v): 0 for v in range(n)}, sides_of(edges, n))[0])


def least_form(edges, n):
    return min(tuple(sorted((perm[s], p, perm[o]) for s, p, o in edges)) for perm in itertools.permutations(range(n)))


def test_forms_are_equal_if_and_only_if_graphs_are_isomorphic():
    r = random.Random(7)
    seen = {}
    for _ in range(250):
        n = r.randint(2, 5)
        edges = {(r.randrange(n), r.choice("pq"), r.randrange(n)) for _ in range(r.randint(1, 6))}
        seen.setdefault((n, least_form(edges, n)), set()).add(form(edges, n))
    assert all(len(forms) == 1 for forms in seen.values())
    assert len({(n, next(iter(f))) for (n, _), f in seen.items()}) == len(seen)
    ring = lambda *nodes: {(a, "p", b) for a, b in zip(nodes, [*nodes[1:], nodes[0]], strict=True)}
    assert form(ring(0, 1, 2, 3, 4, 5), 6) == form(ring(3, 0, 5, 1, 4, 2), 6) != form(ring(0, 1, 2) | ring(3, 4, 5), 6)
    assert len(blank_nodes.canonical_order({str(v): 0 for v in range(40)}, sides_of({(0, "p", v) for v in range(1, 40)}, 40))[1]) == 40


def lines(spark, rows):
    return {tuple(x) for x in blank_nodes.canonical(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_relabelled_graphs_come_out_equal(spark):
    b = lambda s, p, o: (s, p, o, "blank", None, None)
    rows = [("x", "has", "_:a", "blank", None, None), ("_:a", "name", "A", "literal", "str", None), ("_:b", "name", "B", "literal", "str", "en"), b("_:b", "knows", "_:a"), ("_:b", "in", "y", "iri", None, None)]
    rows += [b("_:r1", "next", "_:r2"), b("_:r2", "next", "_:r3"), b("_:r3", "next", "_:r1"), b("_:q1", "next", "_:q2"), b("_:q2", "next", "_:q3"), b("_:q3", "next", "_:q1"), b("_:t", "self", "_:t")]
    rows += [b("_:hub", "leaf", f"_:l{i}") for i in range(5)] + [("x", "p", "_:no", "literal", None, None), rows[0]]
    first = lines(spark, rows)
    names = sorted({t for s, _, o, kind, *_ in rows for t, ok in ((s, True), (o, kind == "blank")) if ok and t.startswith("_:")})
    shuffled = dict(zip(names, random.Random(2).sample(names, len(names)), strict=True))
    again = [(shuffled.get(s, s), p, shuffled.get(o, o) if kind == "blank" else o, kind, d, lang) for s, p, o, kind, d, lang in rows]
    random.Random(3).shuffle(again)
    assert lines(spark, again) == first and len(first) == len(rows) - 1
    assert {x[0] for x in first if x[0].startswith("_:")} | {x[2] for x in first if x[3] == "blank"} == {f"_:b{i}" for i in range(len(names))}
    six = [x for x in rows if "next" not in x] + [b(f"_:s{i}", "next", f"_:s{(i + 1) % 6}") for i in range(6)]
    assert lines(spark, six) != first
    assert lines(spark, []) == set()
