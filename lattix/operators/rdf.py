"""Triples: patterns, closure by rules, constraint checks and line formats. Triples are (s, p, o) rows of strings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.operators.graph import reach
from lattix.operators.shared import cut

TYPE = "rdf:type"


def pattern(triples: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Bindings of one triple pattern; a term that begins with ? is a variable. A variable that comes twice has to be equal."""
    terms = [("s", s), ("p", p), ("o", o)]
    found = triples
    for column, term in terms:
        if not term.startswith("?"):
            found = found.where(F.col(column) == term)
    names: dict[str, str] = {}
    for column, term in terms:
        if term.startswith("?"):
            if term in names:
                found = found.where(F.col(column) == F.col(names[term]))
            names.setdefault(term, column)
    return found.select(*[F.col(c).alias(v[1:]) for v, c in names.items()]).distinct()


def match(triples: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """Bindings of a basic graph pattern: natural joins of its triple patterns."""
    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        return a.join(b, shared) if shared else a.crossJoin(b)

    return reduce(both, [pattern(triples, *p) for p in patterns])


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [c for c in left.columns if c in right.columns], "left")


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that agree with no row of right on the variables that they share; without any, all of left."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared, "left_anti") if shared else left


def path_plus(triples: DataFrame, p: str) -> DataFrame:
    """(s, o) of one step of p or more, as a set."""
    found = reach(triples.where(F.col("p") == p), "s", "o")
    return found.select(F.col("source").alias("s"), F.col("target").alias("o"))


def path_inverse(triples: DataFrame, p: str) -> DataFrame:
    """(s, o) of one step of p against its direction."""
    return triples.where(F.col("p") == p).select(F.col("o").alias("s"), F.col("s").alias("o")).distinct()


def path_star(triples: DataFrame, p: str) -> DataFrame:
    """(s, o) of no step of p or more: also every subject and object with itself."""
    nodes = triples.select(F.col("s").alias("n")).union(triples.select("o")).distinct()
    return path_plus(triples, p).union(nodes.select(F.col("n").alias("s"), F.col("n").alias("o"))).distinct()


def path_sequence(first: DataFrame, second: DataFrame) -> DataFrame:
    """(s, o) of a step of one path, then one of another."""
    ahead = second.select(F.col("s").alias("o"), F.col("o").alias("end"))
    return first.join(ahead, "o").select("s", F.col("end").alias("o")).distinct()


def describe(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """The triples that have one of the nodes (column node) as their subject."""
    return triples.join(nodes.select(F.col("node").alias("s")).distinct(), "s", "left_semi").select("s", "p", "o").distinct()


def default_graph(quads: DataFrame, *graphs: str) -> DataFrame:
    """(s, p, o) of the named graphs (column g) together, each once; of all graphs, if none is named."""
    own = quads.where(F.col("g").isin(*graphs)) if graphs else quads
    return own.select("s", "p", "o").distinct()


def construct(bindings: DataFrame, template: list[tuple[str, str, str]]) -> DataFrame:
    """Triples of a template, one for each of its lines and binding, without repeats."""
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    lines = F.array(*[F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in template])
    return bindings.select(F.explode(lines).alias("t")).select("t.*").dropna().distinct()


def rule_closure(triples: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """All triples that domain, range, subPropertyOf, symmetric, inverseOf, transitive and subClassOf add up to, with the given ones.

    Each round applies all rules to the triples found in the round before, joined with everything for
    transitive properties, until nothing is new. vocabulary has rows (rule, a, b); it is joined as a small table.
    """
    rules = lambda name: vocabulary.where(F.col("rule") == name).select("a", "b")
    known = cut(triples.select("s", "p", "o").distinct())
    fresh = known
    while not fresh.isEmpty():
        over = lambda name: fresh.join(rules(name), F.col("p") == F.col("a"))
        out = [
            over("domain").select("s", F.lit(TYPE).alias("p"), F.col("b").alias("o")),
            over("range").select(F.col("o").alias("s"), F.lit(TYPE).alias("p"), F.col("b").alias("o")),
            over("subPropertyOf").select("s", F.col("b").alias("p"), "o"),
            over("symmetric").select(F.col("o").alias("s"), "p", F.col("s").alias("o")),
            over("inverseOf").select(F.col("o").alias("s"), F.col("b").alias("p"), F.col("s").alias("o")),
            fresh.join(rules("inverseOf"), F.col("p") == F.col("b")).select(F.col("o").alias("s"), F.col("a").alias("p"), F.col("s").alias("o")),
            fresh.where(F.col("p") == TYPE).join(rules("subClassOf"), F.col("o") == F.col("a")).select("s", "p", F.col("b").alias("o")),
        ]
        trans = rules("transitive").select(F.col("a").alias("p"))
        new, all_ = fresh.join(trans, "p", "left_semi"), known.join(trans, "p", "left_semi")
        ahead = lambda df: df.select("p", F.col("s").alias("mid"), F.col("o").alias("end"))
        back = lambda df: df.select("p", "s", F.col("o").alias("mid"))
        out += [back(new).join(ahead(all_), ["p", "mid"]).select("s", "p", F.col("end").alias("o")), back(all_).join(ahead(new), ["p", "mid"]).select("s", "p", F.col("end").alias("o"))]
        fresh = cut(reduce(DataFrame.union, out).distinct().join(known, ["s", "p", "o"], "left_anti"))
        known = known.union(fresh)  # of checkpoints, so what is known isn't written again
    return known


def violations(focus: DataFrame, values: DataFrame, component: str, argument: object = None) -> DataFrame:
    """(component, focus, value) where a constraint fails. focus has a column focus; values has focus and value.

    Components: minCount, maxCount, in, pattern, minLength, maxLength, hasValue, class (argument: a table with a column value of its members), datatype (values
    has one too, null for what is no literal), nodeKind (iri or literal; values has a kind), node (argument: a table of violations of the shape that values have to keep).
    """
    own = focus.select("focus").distinct().join(values, "focus", "left")
    if component in ("minCount", "maxCount"):
        count = own.groupBy("focus").agg(F.count("value").alias("n"))
        found = count.where(F.col("n") < argument if component == "minCount" else F.col("n") > argument).select("focus", F.col("n").cast("string").alias("value"))
    elif component == "hasValue":
        found = focus.select("focus").distinct().join(values.where(F.col("value") == argument), "focus", "left_anti").select("focus", F.lit(None).cast("string").alias("value"))
    elif component == "class":
        found = own.where("value is not null").join(argument.select("value").distinct(), "value", "left_anti").select("focus", "value")
    elif component in ("datatype", "nodeKind"):
        found = own.where(F.col("value").isNotNull() & (F.coalesce("datatype" if component == "datatype" else "kind", F.lit("")) != argument)).select("focus", "value")
    elif component == "node":
        found = own.where("value is not null").join(argument.select(F.col("focus").alias("value")).distinct(), "value", "left_semi").select("focus", "value")
    else:
        fits: Column = {"in": lambda v: v.isin(argument), "pattern": lambda v: v.rlike(argument), "minLength": lambda v: F.char_length(v) >= argument, "maxLength": lambda v: F.char_length(v) <= argument}[component](F.col("value"))
        found = own.where(F.col("value").isNotNull() & ~fits).select("focus", "value")
    return found.select(F.lit(component).alias("component"), "focus", "value")


#: Characters that literals escape by a letter, fixed by the format: tab, backspace, line feed, carriage return, form feed, quotes and backslash.
LETTERS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
#: Those that have to be escaped when written.
WRITTEN = ["\\", '"', "\n", "\r"]


def literal(value: Column) -> Column:
    """A literal as canonical N-Triples has it."""
    letter = {c: k for k, c in LETTERS.items()}
    for c in WRITTEN:
        value = F.replace(value, F.lit(c), F.lit("\\" + letter[c]))
    return F.concat(F.lit('"'), value, F.lit('"'))


def unescaped(value: Column) -> Column:
    r"""A text with its escapes read, each once, from left to right: \ and a letter, \uXXXX and \UXXXXXXXX."""
    whole = F.regexp_extract_all(value, F.lit(r"((?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))
    letters = F.create_map(*(F.lit(x) for pair in LETTERS.items() for x in pair))

    def read(part: Column) -> Column:
        code = F.decode(F.unhex(F.lpad(F.substring(part, 3, 8), 8, "0")), "UTF-32")
        kind = F.substring(part, 2, 1)
        return F.when(~part.startswith("\\"), part).when(kind.isin("u", "U"), code).otherwise(F.coalesce(F.try_element_at(letters, kind), kind))

    return F.when(F.contains(value, F.lit("\\")), F.array_join(F.transform(whole, read), "")).otherwise(value)


def lines(triples: DataFrame, base: str, is_literal: Column) -> DataFrame:
    """(line) of each triple as N-Triples, once; terms are names under base, or literals."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.col(c), F.lit(">"))
    text = F.concat(iri("s"), F.lit(" "), iri("p"), F.lit(" "), F.when(is_literal, literal(F.col("o"))).otherwise(iri("o")), F.lit(" ."))
    return triples.select(text.alias("line")).distinct()


NODE = r"(?:<([^>]*)>|(_:[^\s<>\"]+))"
LINE = rf'^\s*{NODE}\s*<([^>]*)>\s*(?:{NODE}|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*(?:{NODE})?\s*\.\s*(?:#.*)?$'


def parse_lines(text: DataFrame, column: str = "value") -> DataFrame:
    """(s, p, o, kind, datatype, lang, g) of N-Triples and N-Quads lines; comments and what doesn't parse are left out.

    kind is iri, blank or literal; blank nodes keep their label with its _: and are told apart by it alone.
    """
    part = lambda i: F.regexp_extract(column, LINE, i)
    node = lambda i: F.when(part(i + 1) != "", part(i + 1)).otherwise(unescaped(part(i)))
    empty = lambda c: F.when(c != "", c)
    # after the predicate comes a quote if the object is a literal
    literal_ = F.col(column).rlike(rf'^\s*{NODE}\s*<[^>]*>\s*"')
    kind = F.when(literal_, "literal").when(part(5) != "", "blank").otherwise("iri").alias("kind")
    o = F.when(literal_, unescaped(part(6))).otherwise(node(4))
    return text.where(F.col(column).rlike(LINE)).select(node(1).alias("s"), unescaped(part(3)).alias("p"), o.alias("o"), kind, empty(unescaped(part(7))).alias("datatype"), empty(part(8)).alias("lang"), empty(node(9)).alias("g"))


def fragment(column: str) -> Column:
    """The partition of a graph export that holds an IRI's triples: 16 hex digits of its SHA-256."""
    return F.left(F.sha2(F.col(column), 256), F.lit(16))


def valid_name(name: str) -> bool:
    return bool(re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", name)) and len(name) <= 64
