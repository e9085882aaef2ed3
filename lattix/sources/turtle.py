"""Turtle files of any size as triples: read in blocks of lines, whose states at their starts, first and last statements and prefixes are put together by Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from lattix.operators.rdf import LETTERS
from lattix.operators.shared import Scratch

#: Names that the format fixes.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: Up to so many bindings of prefixes are sent to every executor; more are joined by a shuffle.
BROADCAST_BINDINGS = 200_000

_UNIT = r"(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-])"
_NAME = r"[^\W\d_](?:\.*[\w·-])*"
TOKEN = re.compile(
    rf"""(?P<space>[ \t\r\n]+|\#[^\n]*)|(?P<open>\"{{3}}|'{{3}})|(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')|(?P<iri><(?:[^<>"{{}}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}})*>)
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<double>[+-]?(?:\d+(?:\.\d*)?|\.\d+)[eE][+-]?\d+)|(?P<decimal>[+-]?\d*\.\d+)|(?P<integer>[+-]?\d+)
    |(?P<blank>_:\w(?:\.*[\w·-])*)|(?P<name>(?:{_NAME})?:(?:{_UNIT}(?:\.*{_UNIT})*)?)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]()])|(?P<bad>.)""",
    re.X,
)
#: Up to and with the end of a long string.
CLOSE = {q: re.compile(rf"(?:\\.|[^\\])*?{q * 3}", re.S) for q in "\"'"}
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)


def _unescaped(text: str) -> str:
    if "\\" not in text:
        return text
    return ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else LETTERS.get(m[3], m[3]), text)


def _scan(line: str, quote: str) -> Iterator[tuple[str, int, str]]:
    """(kind, end, open quote) of each token of a line that starts in a long string of that quote, or outside ('')."""
    at = 0
    while at < len(line):
        if quote:
            closed = CLOSE[quote].match(line, at)
            at, quote = (closed.end(), "") if closed else (len(line), quote)
            yield "long", at, quote
            continue
        token = TOKEN.match(line, at)
        at = token.end()
        if token.lastgroup == "open":
            quote = token[0][0]
        yield token[0] if token.lastgroup == "mark" else token.lastgroup, at, quote


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, block, start, end) of each block: the quote that is open at its end, for each that may be at its start."""
    seen: dict = {}
    for batch in batches:
        for path, block, line in zip(batch["path"], batch["block"], batch["value"]):
            state = seen.setdefault((path, block), {"": "", '"': '"', "'": "'"})
            plain = '"""' not in line and "'''" not in line
            for start, quote in state.items():
                if not plain:
                    for _, _, quote in _scan(line, quote):
                        pass
                    state[start] = quote
    yield pd.DataFrame([(p, b, s, e) for (p, b), state in seen.items() for s, e in state.items()], columns=["path", "block", "start", "end"])


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """(path, block, start) of one file's blocks: the quote that is open where each starts."""
    quote, out = "", []
    for block, own in rows.groupby("block", sort=True):
        out.append((rows["path"].iloc[0], block, quote))
        quote = dict(zip(own["start"], own["end"]))[quote]
    return pd.DataFrame(out, columns=["path", "block", "start"])


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, block, n, text, ended) of each block's statements; the first may have started before, the last may go on."""
    own, n, quote, held = None, 0, "", []
    for batch in batches:
        out = []
        for path, block, first, line in zip(batch["path"], batch["block"], batch["start"], batch["value"]):
            if own != (path, block):
                if held:
                    out.append((*own, n, "".join(held), False))
                own, n, quote, held = (path, block), 0, first, []
            line, begun = line + "\n", 0
            for kind, end, quote in _scan(line, quote):
                if kind == ".":
                    held.append(line[begun:end])
                    out.append((*own, n, "".join(held), True))
                    n, begun, held = n + 1, end, []
            if begun < len(line):
                held.append(line[begun:])
        yield pd.DataFrame(out, columns=["path", "block", "n", "text", "ended"])
    if held:
        yield pd.DataFrame([(*own, n, "".join(held), False)], columns=["path", "block", "n", "text", "ended"])


class Refused(ValueError):
    """A statement that doesn't follow the format."""


def _tokens(text: str) -> list[tuple[str, str]]:
    found, at = [], 0
    while at < len(text):
        token = TOKEN.match(text, at)
        kind, value, at = token.lastgroup, token[0], token.end()
        if kind == "open":
            closed = CLOSE[value[0]].match(text, at)
            if not closed:
                raise Refused("open string")
            kind, value, at = "string", text[at : closed.end() - 3], closed.end()
        elif kind == "string":
            value = value[1:-1]
        elif kind == "bad":
            raise Refused(f"unexpected {value}")
        if kind != "space":
            found.append((value, "") if kind == "mark" else (kind, value))
    return found


def _term(tokens: list, i: int, fresh: str) -> tuple[tuple, int]:
    """((kind, value, prefix, datatype, prefix of the datatype, language), next place) of the term at a place."""
    kind, value = tokens[i]
    none = (None,) * 3
    if kind == "iri":
        return ("iri", _unescaped(value[1:-1]), None, *none), i + 1
    if kind == "name":
        prefix, local = value.split(":", 1)
        return ("iri", re.sub(r"\\(.)", r"\1", local), prefix, *none), i + 1
    if kind == "blank":
        return ("blank", f"{fresh.split('_g', 1)[0]}_l{value[2:]}", None, *none), i + 1
    if kind in ("integer", "decimal", "double"):
        return ("literal", value, None, XSD + kind, None, None), i + 1
    if kind == "word" and value in ("true", "false"):
        return ("literal", value, None, XSD + "boolean", None, None), i + 1
    if kind == "word" and value == "a":
        return ("iri", RDF + "type", None, "a", None, None), i + 1
    if kind != "string":
        raise Refused(f"unexpected {kind} {value}".rstrip())
    text, after = _unescaped(value), tokens[i + 1][0] if i + 1 < len(tokens) else ""
    if after == "at":
        return ("literal", text, None, None, None, tokens[i + 1][1][1:]), i + 2
    if after == "type":
        if i + 2 >= len(tokens) or tokens[i + 2][0] not in ("iri", "name"):
            raise Refused("a type without a name")
        named, j = _term(tokens, i + 2, fresh)
        return ("literal", text, None, named[1], named[2], None), j
    return ("literal", text, None, None, None, None), i + 1


def _parsed(tokens: list, fresh: str) -> Iterator[tuple]:
    """("prefix" or "base", prefix, IRI) of a statement's directives, ("triple", subject, predicate, object) of its triples."""
    i, blanks = 0, 0
    while i < len(tokens) and (tokens[i][0] == "at" or tokens[i][0] == "word" and tokens[i][1].upper() in ("PREFIX", "BASE")):
        kind, dotted = tokens[i][1].lstrip("@").lower(), tokens[i][0] == "at"
        need = ["name", "iri"] if kind == "prefix" else ["iri"] if kind == "base" else ["?"]
        got = tokens[i + 1 : i + 1 + len(need)]
        i += 1 + len(need)
        if [g[0] for g in got] != need or kind == "prefix" and not got[0][1].endswith(":") or dotted and tokens[i : i + 1] != [(".", "")]:
            raise Refused("a directive that doesn't follow the format")
        yield kind, got[0][1][:-1] if kind == "prefix" else "", _unescaped(got[-1][1][1:-1])
        i += dotted

    def blank():
        nonlocal blanks
        blanks += 1
        return ("blank", f"{fresh}_{blanks}", None, None, None, None)

    named = lambda value: ("iri", RDF + value, None, None, None, None)
    # a level: its kind, subject, predicate, whether its predicate has an object, and whether it may do without a predicate
    levels = [["top", None, None, False, False]]
    while i < len(tokens):
        kind, level = tokens[i][0], levels[-1]
        where, subject, verb, done, bare = level
        if kind == "[" or kind == "(":
            if where != "list" and (done or subject is not None and verb is None):
                raise Refused(f"unexpected {kind}")
            levels.append(["props", blank(), None, False, True] if kind == "[" else ["list", None, None, False, True])
            i += 1
            continue
        if kind in ("]", ")"):
            if (where, kind) not in (("props", "]"), ("list", ")")) or where == "props" and verb is not None and not done:
                raise Refused(f"unexpected {kind}")
            levels.pop()
            if where == "list":
                term = subject or named("nil")
                if subject:
                    yield "triple", verb, named("rest"), named("nil")
            else:
                term = subject
            level, i = levels[-1], i + 1
            where, subject, verb, done, _ = level
            if subject is None and where == "top":
                level[4] = kind == "]" and tokens[i - 2][0] != "["
        elif kind == ";":
            if where == "list" or not done and (verb is not None or where == "top" and not bare):
                raise Refused("unexpected ;")
            level[2], level[3], level[4] = None, False, True
            i += 1
            continue
        elif kind == ",":
            if not done:
                raise Refused("unexpected ,")
            level[3] = False
            i += 1
            continue
        elif kind == ".":
            if where != "top" or i + 1 < len(tokens) or not (done or bare and verb is None):
                raise Refused("unexpected .")
            return
        else:
            term, i = _term(tokens, i, fresh)
        if where == "list":
            cell = blank()
            if subject is None:
                level[1] = cell
            else:
                yield "triple", verb, named("rest"), cell
            level[2] = cell
            yield "triple", cell, named("first"), term
        elif subject is None:
            if term[0] == "literal" or term[3] == "a":
                raise Refused("a subject that is no node")
            level[1] = term
        elif verb is None:
            if term[0] != "iri":
                raise Refused("a predicate that is no IRI")
            level[2], level[3] = term, False
        elif done or term[3] == "a":
            raise Refused("an object too many")
        else:
            yield "triple", subject, verb, term
            level[3] = True
    if levels[-1][0] != "top" or levels[0][1] is not None:
        raise Refused("unfinished")


PARSED = "path string, block long, n long, what string, s string, sx string, p string, px string, o string, ox string, kind string, datatype string, dx string, lang string, finding string"


def _statements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in PARSED.split(", ")]
    for batch in batches:
        out = []
        for path, block, n, text, scope in zip(batch["path"], batch["block"], batch["n"], batch["text"], batch["scope"]):
            own, at = [], (path, block, n)
            try:
                for what, s, p, *o in _parsed(_tokens(text), f"_:{scope}_g{block}_{n}"):
                    if what == "triple":
                        o = o[0]
                        own.append((*at, what, s[1], s[2], p[1], p[2], o[1], o[2], o[0], o[3], o[4], o[5], None))
                    else:
                        own.append((*at, what, None, s, None, None, p, None, None, None, None, None, None))
            except Refused as e:
                own = [(*at, "finding", None, None, None, None, text, None, None, None, None, None, str(e))]
            out += own
        yield pd.DataFrame(out, columns=columns)


#: An IRI's parts: scheme, authority, path, query and fragment.
PARTS = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?", re.S)


def resolved(base: str | None, reference: str) -> str:
    """An IRI reference against a base, by RFC 3986; as it is without a base."""
    scheme, host, path, query, tail = PARTS.fullmatch(reference).groups()
    if scheme or not base:
        return reference
    scheme, base_host, base_path, base_query, _ = PARTS.fullmatch(base).groups()
    if host is None:
        host = base_host
        if not path:
            path, query = base_path, query or base_query
        elif not path.startswith("/"):
            path = "/" + path if base_host is not None and not base_path else base_path[: base_path.rfind("/") + 1] + path
        if path != base_path:
            kept: list[str] = []
            parts = path.split("/")
            for i, part in enumerate(parts):
                if part == ".." and len(kept) > 1:
                    kept.pop()
                if part not in (".", ".."):
                    kept.append(part)
                elif i + 1 == len(parts):
                    kept.append("")
            path = "/".join(kept)
    return f"{scheme + ':' if scheme else ''}{'//' + host if host is not None else ''}{path}{query or ''}{tail or ''}"


@F.pandas_udf(StringType())
def _resolve(base: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([resolved(b, r) if r is not None else None for b, r in zip(base, reference)])


def _bases(rows: pd.DataFrame) -> pd.DataFrame:
    """Base directives of one file in order, each against the one before."""
    rows, last, out = rows.sort_values(["block", "n"]), None, []
    for given, reference in zip(rows["given"], rows["iri"]):
        last = resolved(last or given, reference)
        out.append(last)
    return rows.assign(iri=out)[["path", "block", "n", "iri"]]


def _spans(found: DataFrame, by: list[str]) -> DataFrame:
    """Bindings (by, iri, since, until): each in force from its statement on, until one with another IRI."""
    order = Window.partitionBy(*by).orderBy("since")
    changed = found.withColumn("__last", F.lag("iri").over(order)).where("__last is null or __last != iri").drop("__last")
    return changed.withColumn("until", F.lead("since").over(order))


def _bound(bindings: DataFrame) -> DataFrame:
    return F.broadcast(bindings) if bindings.count() <= BROADCAST_BINDINGS else bindings


def read_turtle(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """(path, s, p, o, kind, datatype, lang, finding) of the triples of Turtle files.

    kind is iri, blank or literal; plain literals have no datatype. Relative IRIs are resolved against @base, before that against base, without either they stay as they are.
    Blank nodes of different files have different labels. A statement that doesn't follow the format, or names a prefix that isn't bound, gives one row: its text as o and a finding, all else null.
    No text, comments only, an empty file: no rows. Repeated triples stay repeated.

    A block's lines are read one after another; whole statements stay where they are, only those that cross the bounds of blocks are moved. Memory holds a statement at a time.
    """
    scratch = Scratch(spark)
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    # a row for each block and quote: which one is open where a block starts
    ends = scratch.cut(text.mapInPandas(_ends, "path string, block long, start string, end string"))
    starts = ends.groupBy("path").applyInPandas(_starts, "path string, block long, start string")
    # only blocks that follow one with an open string need to be told
    inside = scratch.cut(starts.where("start != ''"))
    begun = text.join(_bound(inside), ["path", "block"], "left") if not inside.isEmpty() else text.withColumn("start", F.lit(""))
    pieces = scratch.cut(begun.select("path", "block", F.coalesce("start", F.lit("")).alias("start"), "value").mapInPandas(_pieces, "path string, block long, n long, text string, ended boolean"))
    # the first and last pieces of blocks: those up to and with an end are one statement
    edge = pieces.where("(n = 0 and block > 0) or not ended")
    counted = edge.select("path", "block", "n", F.coalesce(F.sum(F.col("ended").cast("long")).over(Window.partitionBy("path").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("g"))
    joined = edge.join(counted, ["path", "block", "n"]).groupBy("path", "g").agg(F.array_sort(F.collect_list(F.struct("block", "n", "text"))).alias("x"))
    crossing = joined.select("path", F.col("x")[0]["block"].alias("block"), F.col("x")[0]["n"].alias("n"), F.array_join("x.text", "").alias("text"))
    statements = pieces.where("(n > 0 or block = 0) and ended").select("path", "block", "n", "text").unionByName(crossing)
    scope = F.lower(F.hex(F.xxhash64("path")))
    parsed = scratch.cut(statements.withColumn("scope", scope).mapInPandas(_statements, PARSED))

    since = F.struct("block", "n").alias("since")
    given = F.lit(base).cast("string").alias("given")
    last = parsed.where("what = 'base'").groupBy("path", "block", "n").agg(F.last("o").alias("iri")).select("*", given)
    bases = scratch.cut(_spans(last.groupBy("path").applyInPandas(_bases, "path string, block long, n long, iri string").select("path", "iri", since), ["path"]))

    def against(df: DataFrame, *columns: str) -> DataFrame:
        """df with the IRIs in these columns resolved; at is where each row stands."""
        relative = F.lit(False)
        for c in columns:
            relative = relative | F.coalesce(~F.col(c).rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & F.col(f"{c}_iri"), F.lit(False))
        rest = df.where(relative).alias("d")
        force = (F.col("d.path") == F.col("b.path")) & (F.col("d.at") >= F.col("b.since")) & (F.col("b.until").isNull() | (F.col("d.at") < F.col("b.until")))
        met = rest.join(_bound(bases).alias("b"), force, "left").select("d.*", F.coalesce("b.iri", given).alias("__base"))
        for c in columns:
            met = met.withColumn(c, F.when(F.col(f"{c}_iri"), _resolve("__base", c)).otherwise(F.col(c)))
        return df.where(~relative).unionByName(met.drop("__base"))

    found = parsed.where("what = 'prefix'").groupBy("path", "sx", "block", "n").agg(F.last("o").alias("iri")).withColumn("at", F.struct("block", "n")).withColumn("iri_iri", F.lit(True))
    bindings = scratch.cut(_spans(against(found, "iri").select("path", F.col("sx").alias("prefix"), "iri", F.col("at").alias("since")), ["path", "prefix"]))
    small = bindings.count() <= BROADCAST_BINDINGS
    rows = parsed.where("what = 'triple'").withColumn("at", F.struct("block", "n")).withColumn("finding", F.lit(None).cast("string"))
    is_iri: dict[str, Column] = {"s": ~F.col("s").startswith("_:"), "p": F.lit(True), "o": F.col("kind") == "iri", "datatype": F.col("datatype").isNotNull()}
    prefix = {"s": "sx", "p": "px", "o": "ox", "datatype": "dx"}
    for c, x in prefix.items():
        met = bindings.select(F.col("path").alias("__path"), F.col("prefix").alias("__prefix"), F.col("iri").alias("__iri"), F.col("since").alias("__since"), F.col("until").alias("__until"))
        force = (F.col("path") == F.col("__path")) & (F.col(x) == F.col("__prefix")) & (F.col("at") >= F.col("__since")) & (F.col("__until").isNull() | (F.col("at") < F.col("__until")))
        unbound = F.col(x).isNotNull() & F.col("__iri").isNull()
        rows = rows.withColumn(f"{c}_iri", is_iri[c] & F.col(x).isNull()).join(F.broadcast(met) if small else met, force, "left")
        rows = rows.withColumn("finding", F.when(unbound, F.concat(F.lit("prefix without a binding: "), F.col(x))).otherwise(F.col("finding")))
        rows = rows.withColumn(c, F.when(F.col(x).isNotNull(), F.concat("__iri", c)).otherwise(F.col(c))).drop("__path", "__prefix", "__iri", "__since", "__until")
    columns, statement = ["s", "p", "o", "kind", "datatype", "lang"], ["path", "block", "n"]
    unbound = scratch.cut(rows.where("finding is not null").groupBy(*statement).agg(F.min("finding").alias("finding")))
    good = against(rows.where("finding is null"), *prefix)
    if not unbound.isEmpty():
        good = good.join(unbound.select(*statement), statement, "left_anti")
    bad = parsed.where("what = 'finding'").select(*statement, "finding", "o").unionByName(unbound.join(statements, statement).select(*statement, "finding", F.col("text").alias("o")))
    none = F.lit(None).cast("string")
    return good.select("path", *columns, "finding").unionByName(bad.select("path", *[F.col(c) if c == "o" else none.alias(c) for c in columns], "finding"))
