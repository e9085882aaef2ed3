"""Constraints on triples, from a table of shapes: targets, property and node shapes, paths, twelve components.

All shapes are evaluated together: what a shape asks for is a row, and each kind of parameter is one join of the pairs (shape, focus) or their values with
its rows. Neither the number of shapes nor that of foci changes the plan. Shapes that refer to others are followed to a fixpoint in both
directions: first which pairs have to be judged at all, then which of them fail.

A shapes table has (shape, parameter, value): targetNode, targetClass, targetSubjectsOf, targetObjectsOf; path (steps joined by spaces, ^ before one that goes
backwards; none for a node shape); property and node with the name of another shape; minCount, maxCount, minLength, maxLength, hasValue, in (a row for each value), class, datatype,
nodeKind, pattern, flags; severity. Data are triples (s, p, o, kind, datatype), kind being iri, blank or literal of o.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.operators.graph import reach
from lattix.operators.shared import cut

SH = "http://www.w3.org/ns/shacl#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
SUBCLASS = "rdfs:subClassOf"
#: What each kind of node that nodeKind can name allows.
NODE_KINDS = {"IRI": ("iri",), "Literal": ("literal",), "BlankNode": ("blank",), "BlankNodeOrIRI": ("blank", "iri"), "BlankNodeOrLiteral": ("blank", "literal"), "IRIOrLiteral": ("iri", "literal")}
PARAMETERS = ("targetNode", "targetClass", "targetSubjectsOf", "targetObjectsOf", "property", "node", "minCount", "maxCount", "minLength", "maxLength", "hasValue", "in", "class", "datatype", "nodeKind", "pattern", "flags", "severity")


def _rows(shapes: DataFrame, parameter: str, name: str) -> DataFrame:
    return shapes.where(F.col("parameter") == parameter).select("shape", F.col("value").alias(name)).distinct()


def _kind(c: str) -> Column:
    return F.when(F.col(c).startswith("_:"), "blank").otherwise("iri")


def members(data: DataFrame, type_: str = "rdf:type", subclass: str = SUBCLASS) -> DataFrame:
    """(node, class) of what is a member of a class or of one below it."""
    own = data.where(F.col("p") == type_).select(F.col("s").alias("node"), F.col("o").alias("class"))
    above = reach(data.where(F.col("p") == subclass), "s", "o").select(F.col("source").alias("class"), F.col("target").alias("above"))
    return own.union(own.join(above, "class").select("node", "above")).distinct()


def targets(shapes: DataFrame, data: DataFrame, classes: DataFrame) -> DataFrame:
    """(shape, focus) of all four kinds of targets; classes is what members() gives."""
    return reduce(DataFrame.union, [
        _rows(shapes, "targetNode", "focus").select("shape", "focus"),
        _rows(shapes, "targetClass", "class").join(classes, "class").select("shape", "node"),
        _rows(shapes, "targetSubjectsOf", "p").join(data.select("p", "s"), "p").select("shape", "s"),
        _rows(shapes, "targetObjectsOf", "p").join(data.select("p", "o"), "p").select("shape", "o"),
    ]).distinct()


def values(asked: DataFrame, shapes: DataFrame, data: DataFrame) -> DataFrame:
    """(shape, focus, value, kind, datatype) of pairs (shape, focus, kind, datatype): what the shape's path leads to, or the focus itself without one."""
    steps = _rows(shapes, "path", "path").select("shape", F.posexplode(F.split("path", " ")).alias("at", "step"))
    steps = cut(steps.select("shape", "at", F.regexp_replace("step", r"^\^", "").alias("p"), F.col("step").startswith("^").alias("back")))
    longest = (steps.agg(F.max("at")).first()[0] or 0) + 1
    pathed = steps.select("shape").distinct()
    own = asked.join(pathed, "shape", "left_anti").select("shape", "focus", F.col("focus").alias("value"), "kind", "datatype")
    back = data.select(F.col("o").alias("from"), "p", F.lit(True).alias("back"), F.col("s").alias("to"), _kind("s").alias("kind"), F.lit(None).cast("string").alias("datatype"))
    onward = data.select(F.col("s").alias("from"), "p", F.lit(False), F.col("o"), "kind", "datatype").union(back.select("from", "p", "back", "to", "kind", "datatype")).toDF("from", "p", "back", "to", "kind", "datatype")
    walk, done = asked.join(pathed, "shape", "left_semi").select("shape", "focus", F.col("focus").alias("from")), []
    for at in range(longest):
        step = steps.where(F.col("at") == at).select("shape", "p", "back")
        reached = walk.join(step, "shape").join(onward, ["from", "p", "back"]).select("shape", "focus", "to", "kind", "datatype").distinct()
        more = steps.where(F.col("at") == at + 1).select("shape")
        done.append(reached.join(more, "shape", "left_anti"))
        walk = reached.join(more, "shape", "left_semi").select("shape", "focus", F.col("to").alias("from")).distinct()
    return reduce(DataFrame.union, done, own)


def _asked(start: DataFrame, links: DataFrame, shapes: DataFrame, data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs (shape, focus, kind, datatype) that start and what links (shape, other) pass on lead to, and the values of all."""
    known = fresh = cut(start)
    seen = cut(values(fresh, shapes, data))
    every = seen
    while True:
        passed = seen.join(links, "shape").select(F.col("other").alias("shape"), F.col("value").alias("focus"), "kind", "datatype").distinct()
        fresh = cut(passed.join(known.select("shape", "focus", "kind"), ["shape", "focus", "kind"], "left_anti"))
        if fresh.isEmpty():
            return known, every
        known = known.union(fresh)
        seen = cut(values(fresh, shapes, data))
        every = every.union(seen)


def broken(pairs: DataFrame, found: DataFrame, shapes: DataFrame, classes: DataFrame) -> DataFrame:
    """(shape, focus, component, value) of what fails but for node and property: pairs (shape, focus) and their values."""
    own = found.join(pairs.select("shape").distinct(), "shape", "left_semi")
    counted = pairs.select("shape", "focus").distinct().join(own.groupBy("shape", "focus").agg(F.count("*").alias("n")), ["shape", "focus"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    flags = _rows(shapes, "flags", "flags")
    rules = lambda name: _rows(shapes, name, "rule")
    listed = rules("in")
    text = F.when(F.col("kind") != "blank", F.col("value"))  # a blank node has no text and fails
    kinds = F.create_map(*(x for k, v in NODE_KINDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    out = {
        "minCount": counted.join(rules("minCount"), "shape").where("n < bigint(rule)").withColumn("value", F.lit(None).cast("string")),
        "maxCount": counted.join(rules("maxCount"), "shape").where("n > bigint(rule)").withColumn("value", F.lit(None).cast("string")),
        "hasValue": pairs.join(rules("hasValue"), "shape").join(own.select("shape", "focus", F.col("value").alias("rule")), ["shape", "focus", "rule"], "left_anti").withColumn("value", F.lit(None).cast("string")),
        "in": own.join(listed.select("shape").distinct(), "shape", "left_semi").join(listed.withColumnRenamed("rule", "value"), ["shape", "value"], "left_anti"),
        "class": own.join(rules("class"), "shape").join(classes.select(F.col("node").alias("value"), F.col("class").alias("rule")), ["value", "rule"], "left_anti"),
        "datatype": own.join(rules("datatype"), "shape").where("kind != 'literal' or not(datatype <=> rule)"),
        "nodeKind": own.join(rules("nodeKind"), "shape").where(~F.coalesce(F.array_contains(F.try_element_at(kinds, F.col("rule")), F.col("kind")), F.lit(False))),
        "minLength": own.join(rules("minLength"), "shape").where(F.coalesce(F.char_length(text) < F.expr("bigint(rule)"), F.lit(True))),
        "maxLength": own.join(rules("maxLength"), "shape").where(F.coalesce(F.char_length(text) > F.expr("bigint(rule)"), F.lit(True))),
        "pattern": own.join(rules("pattern"), "shape").join(flags, "shape", "left").where(F.coalesce(~F.rlike(text, F.concat(F.when(F.col("flags") != "", F.concat(F.lit("(?"), "flags", F.lit(")"))).otherwise(""), "rule")), F.lit(True))),
    }
    return reduce(DataFrame.union, [df.select("shape", "focus", F.lit(name).alias("component"), "value") for name, df in out.items()]).distinct()


def names(shapes: DataFrame) -> DataFrame:
    """(shape, name): a shape's own name, or for one without (a blank node) the least of its parents' names, then > and its path."""
    every = shapes.select("shape").distinct()
    path = _rows(shapes, "path", "path")
    named = cut(every.where(~F.col("shape").startswith("_:")).withColumn("name", F.col("shape")))
    parents = shapes.where("parameter = 'property'").select(F.col("shape").alias("parent"), F.col("value").alias("shape"))
    parents = parents.where(F.col("shape").startswith("_:")).distinct()
    left = cut(parents)
    while not left.isEmpty():  # a shape is named once all its parents are
        waits = left.join(named.select(F.col("shape").alias("parent")), "parent", "left_anti").select("shape").distinct()
        ready = cut(left.join(waits, "shape", "left_anti").join(named.withColumnsRenamed({"shape": "parent", "name": "above"}), "parent").groupBy("shape").agg(F.min("above").alias("above")))
        if ready.isEmpty():
            break
        named = cut(named.union(ready.join(path, "shape", "left").select("shape", F.concat("above", F.lit(" > "), F.coalesce("path", F.lit(""))))))
        left = cut(left.join(ready.select("shape"), "shape", "left_anti"))
    return every.join(named, "shape", "left").select("shape", F.coalesce("name", F.lit("a blank node")).alias("name"))


def report(shapes: DataFrame, data: DataFrame, type_: str = "rdf:type", subclass: str = SUBCLASS) -> DataFrame:
    """(focus, shape, path, component, value, severity): a row for each result of the targets and of the property shapes that they lead to.

    value is null for components that judge all values of a focus at once. A value that breaks a shape named by node is one result, whatever
    is wrong with it. Repeated triples count once; shapes may refer to each other in circles, and fail then only by what is found wrong somewhere. Severity is Violation if none is given.
    """
    shapes = cut(shapes.select("shape", "parameter", "value").distinct())
    data = cut(data.select("s", "p", "o", "kind", "datatype").where("s is not null and p is not null and o is not null").distinct())
    classes = cut(members(data, type_, subclass))
    literal = data.where("kind = 'literal'").select(F.col("o").alias("focus"), "kind", "datatype").distinct()
    aimed = targets(shapes, data, classes)
    at_objects = _rows(shapes, "targetObjectsOf", "p").join(data, "p").select("shape", F.col("o").alias("focus"), "kind", "datatype")
    plain = aimed.join(at_objects.select("shape", "focus"), ["shape", "focus"], "left_anti").select("shape", "focus", _kind("focus").alias("kind"), F.lit(None).cast("string").alias("datatype"))
    start = cut(at_objects.union(plain).distinct())
    properties, nodes = (_rows(shapes, name, "other") for name in ("property", "node"))
    told, _ = _asked(start, properties, shapes, data)
    pairs, found = _asked(start, cut(properties.union(nodes).distinct()), shapes, data)
    pairs, found = cut(pairs), cut(found)
    direct = cut(broken(pairs, found, shapes, classes))
    failing = fresh = cut(direct.select("shape", "focus").distinct())
    below = cut(found.join(properties.union(nodes).distinct(), "shape").select("shape", "focus", "other", "value").distinct())
    while not fresh.isEmpty():
        up = below.join(fresh.withColumnsRenamed({"shape": "other", "focus": "value"}), ["other", "value"]).select("shape", "focus").distinct()
        fresh = cut(up.join(failing, ["shape", "focus"], "left_anti"))
        failing = failing.union(fresh)
    nested = found.join(nodes, "shape").join(failing.withColumnsRenamed({"shape": "other", "focus": "value"}), ["other", "value"], "left_semi")
    every = direct.union(nested.select("shape", "focus", F.lit("node").alias("component"), "value").distinct())
    kept = every.join(told.select("shape", "focus").distinct(), ["shape", "focus"], "left_semi")
    out = kept.join(names(shapes), "shape").join(_rows(shapes, "path", "path"), "shape", "left").join(_rows(shapes, "severity", "severity"), "shape", "left")
    return out.select("focus", F.col("name").alias("shape"), "path", "component", "value", F.coalesce("severity", F.lit("Violation")).alias("severity")).distinct()


def shapes_of(triples: DataFrame) -> DataFrame:
    """(shape, parameter, value): the shapes table of triples (s, p, o) in the SHACL vocabulary with full names. Lists of in and paths, and inverse paths, are read; other terms are left out."""
    own = cut(triples.where(F.col("p").startswith(SH)).select("s", F.substring("p", len(SH) + 1, 100).alias("parameter"), "o").distinct())
    first, rest = (triples.where(F.col("p") == RDF + x).select("s", "o") for x in ("first", "rest"))
    heads = own.select(F.col("o").alias("head")).distinct().join(first.select(F.col("s").alias("head")).distinct(), "head", "left_semi")
    links = rest.where(F.col("o") != RDF + "nil")
    cells = reach(links, "s", "o", starts=heads.select(F.col("head").alias("source"))).select(F.col("source").alias("head"), F.col("target").alias("s"), "depth")
    cells = cells.union(heads.select("head", F.col("head").alias("s"), F.lit(0).alias("depth")))
    items = cut(cells.join(first, "s").select("head", F.col("depth").alias("at"), F.col("o").alias("item")))
    back = own.where("parameter = 'inversePath'").select(F.col("s").alias("node"), F.concat(F.lit("^"), "o").alias("step"))
    plain = own.where(F.col("parameter").isin(*PARAMETERS) & (F.col("parameter") != "in")).select(F.col("s").alias("shape"), "parameter", F.when(F.col("parameter").isin("nodeKind", "severity"), F.replace("o", F.lit(SH))).otherwise(F.col("o")).alias("value"))
    listed = own.where("parameter = 'in'").join(items, F.col("o") == F.col("head")).select(F.col("s").alias("shape"), "parameter", F.col("item").alias("value"))
    steps = own.where("parameter = 'path'").select(F.col("s").alias("shape"), F.col("o").alias("head"))
    steps = steps.join(items, "head", "left").select("shape", F.coalesce("at", F.lit(0)).alias("at"), F.coalesce("item", "head").alias("node")).join(back, "node", "left")
    paths = steps.groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("step", "node").alias("step")))).alias("steps"))  # the steps of one path
    return plain.union(listed).union(paths.select("shape", F.lit("path"), F.array_join("steps.step", " "))).distinct()
