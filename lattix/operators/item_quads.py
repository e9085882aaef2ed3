"""Items as RDF quads, and quads as canonical N-Quads. Quads are rows (s, p, o, kind, datatype, lang): kind is iri or literal, and only literals have the last two."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.operators.links import RELATIONS

# Vocabularies.
DCTERMS = "http://purl.org/dc/terms/"
PROV = "http://www.w3.org/ns/prov#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
SCHEMA = "https://schema.org/"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XSD = "http://www.w3.org/2001/XMLSchema#"
DATE_TIME, STRING = f"{XSD}dateTime", f"{XSD}string"

# The folder of each type's pages, and the types that are concepts of the scheme.
PLURALS = {"concept": "concepts", "procedure": "procedures", "lesson": "lessons", "episode": "episodes", "gate": "gates", "cluster": "clusters"}
CONCEPTS = ("concept", "lesson")

# A key of an item, its property in the vocabulary of items, the types that have it (all, if none is named), and whether it is a time.
PROPERTIES = (
    ("status", "status", (), False),
    ("kind", "kind", ("concept",), False),
    ("stale_after", "staleAfter", (), True),
    ("prov.origin", "origin", (), False),
    ("prov.operator", "operator", (), False),
    ("prov.model", "model", (), False),
    ("level", "level", ("gate",), False),
    ("severity", "severity", ("lesson",), False),
    ("outcome", "outcome", ("episode",), False),
    ("generated.by", "generatedBy", (), False),
    ("generated.at", "generatedAt", (), True),
    ("produces", "produces", ("concept",), False),
    ("consumes", "consumes", ("concept",), False),
    ("task_state", "taskState", ("concept",), False),
)
# The property of each link key and, if the links also run back under another name, that of the inverse; without a prefix they are of the vocabulary of items.
LINKS = {
    "related": (f"{SKOS}related", None), "broader": (f"{SKOS}broader", f"{SKOS}narrower"), "narrower": (f"{SKOS}narrower", f"{SKOS}broader"), "uses": ("uses", "usedBy"),
    "requires": (f"{DCTERMS}requires", f"{DCTERMS}isRequiredBy"), "excludes": ("excludes", None), "derived-from": (f"{PROV}wasDerivedFrom", None), "contradicts": ("contradicts", None),
    "supersedes": (f"{DCTERMS}replaces", f"{DCTERMS}isReplacedBy"), "implements": ("implements", "implementedBy"), "verifies": ("verifies", "isVerifiedBy"), "covers": ("covers", "coveredBy"),
    "blocked-by": ("blockedBy", "blocks"), "decided-by": ("decidedBy", "decides"),
}
SEMANTIC = ("related", "broader", "narrower")
# Members of a source, a review and an attachment with their properties.
SOURCE = (("resource", f"{DCTERMS}source", STRING), ("title", f"{DCTERMS}title", STRING), ("author", f"{DCTERMS}creator", STRING), ("year", f"{DCTERMS}date", STRING), ("verified", "verifiedOn", DATE_TIME), ("grade", "grade", STRING))
REVIEW = (("by", "verifiedBy", STRING), ("at", "verifiedAt", DATE_TIME))
ATTACHMENT = (("media_type", f"{DCTERMS}format", STRING), ("license", f"{DCTERMS}license", STRING), ("file", f"{DCTERMS}source", STRING), ("alt", f"{DCTERMS}title", STRING), ("sha256", "sha256", STRING))

QUAD = "struct<s: string, p: string, o: string, kind: string, datatype: string, lang: string>"


def instant(c: Column) -> Column:
    """A day as its midnight; an instant as it is."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(c, F.lit("T00:00:00Z"))).otherwise(c)


def _literal(s: Column, p: str, value: Column, datatype: str = STRING, lang: Column | None = None) -> Column:
    text = instant(value.cast("string")) if datatype == DATE_TIME else value.cast("string")
    told = F.lit(None).cast("string") if lang is not None else F.lit(datatype)
    return F.when(text.isNotNull(), F.struct(s.alias("s"), F.lit(p).alias("p"), text.alias("o"), F.lit("literal").alias("kind"), told.alias("datatype"), (F.lit(None).cast("string") if lang is None else lang).alias("lang")))


def _edge(s: Column, p: str, o: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.when(o.isNotNull(), F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("kind"), none.alias("datatype"), none.alias("lang")))


def _has(items: DataFrame, path: str) -> bool:
    top, _, rest = path.partition(".")
    return top in items.columns and (not rest or rest in items.select(f"`{top}`.*").columns)


def item_index(items: DataFrame, base: str) -> DataFrame:
    """(slug, type, iri) of the items whose type has pages; of items with one slug the first in order of types counts."""
    plurals = F.create_map(*[F.lit(x) for pair in PLURALS.items() for x in pair])
    own = items.where(F.col("type").isin(*PLURALS)).groupBy("slug").agg(F.min("type").alias("type"))
    return own.withColumn("iri", F.concat(F.lit(base.rstrip("/") + "/"), F.element_at(plurals, F.col("type")), F.lit("/"), "slug", F.lit("/")))


def resolved(values: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """values with column replaced by (iri, type) of the item that it names by slug or slug#anchor; rows that name none go."""
    target = index.select(F.col("slug").alias("__slug"), F.col("iri").alias("__to"), F.col("type").alias("target_type"))
    found = values.withColumn("__slug", F.substring_index(column, "#", 1)).join(target, "__slug")
    anchor = F.when(F.contains(column, F.lit("#")), F.substring(column, F.length("__slug") + 1, F.length(column))).otherwise("")
    return found.withColumn(column, F.concat("__to", anchor)).drop("__slug", "__to")


def project(items: DataFrame, base: str, ns: str, lang: str = "en", licence: str | None = None, terms: str | None = None, mentions: DataFrame | None = None, citations: DataFrame | None = None) -> DataFrame:
    """The quads of items (type, slug and any of the keys above; nested ones as structs, lists as arrays), each once.

    ns is the vocabulary of items. What an item lacks gives nothing; items of other types give none. Links, memberships and mentions (source, target) go to items
    that are there; a cluster takes no part in related, broader and narrower, which nest clusters as members instead. citations has (source, see_also, peer). With a licence, items say it, and the terms of their use.
    """
    name = lambda p: p if ":" in p else ns + p
    index = item_index(items, base)
    own = items.where(F.col("type").isin(*PLURALS)).join(index.select("slug", "iri"), "slug").withColumnRenamed("iri", "__iri")
    s, kind = F.col("__iri"), F.col("type")
    tongue = F.lower(F.coalesce(F.col("lang"), F.lit(lang))) if "lang" in items.columns else F.lit(lang)
    listed: list[Column] = []  # arrays of quads
    one: list[Column] = [_edge(s, RDF_TYPE, F.concat(F.lit(ns), F.initcap(kind))), _edge(s, f"{SKOS}inScheme", F.when(kind.isin(*CONCEPTS), base.rstrip("/") + "/"))]
    for key, p in (("title", "prefLabel"), ("description", "definition")):
        if _has(items, key):
            one.append(_literal(s, SKOS + p, F.col(key), lang=tongue))
    each = lambda c, f: F.coalesce(F.transform(c, f), F.array().cast(f"array<{QUAD}>"))
    if _has(items, "aliases"):
        listed.append(each(F.col("aliases"), lambda x: _literal(s, f"{SKOS}altLabel", x, lang=tongue)))
    if licence is not None:
        one += [_literal(s, f"{SCHEMA}license", F.lit(licence)), _literal(s, f"{SCHEMA}usageInfo", F.lit(terms if terms is not None else licence))]
    for key, p, types, time in PROPERTIES:
        if not _has(items, key):
            continue
        value, datatype = F.col(key), DATE_TIME if time else STRING
        fits = kind.isin(*types) if types else F.lit(True)
        if dict(items.select(value.alias("v")).dtypes)["v"].startswith("array"):
            listed.append(each(F.when(fits, value), lambda x: _literal(s, ns + p, x, datatype)))
        else:
            one.append(_literal(s, ns + p, F.when(fits, value), datatype))
    dates = {k: F.col(k).cast("string") if _has(items, k) else F.lit(None).cast("string") for k in ("date", "modified", "status")}
    one += [_literal(s, f"{DCTERMS}created", dates["date"], DATE_TIME), _literal(s, f"{DCTERMS}modified", dates["modified"], DATE_TIME)]
    one.append(_literal(s, f"{ns}retiredAt", F.when(dates["status"] == "retired", F.coalesce(dates["modified"], dates["date"])), DATE_TIME))
    if _has(items, "warrant"):
        good = F.col("warrant.source").isNotNull() & (F.col("warrant.source") != "") & ~F.col("warrant.source").rlike(r"[\r\n]") & F.col("warrant.type").isNotNull()
        one += [_literal(s, f"{DCTERMS}source", F.when(good, F.col("warrant.source"))), _literal(s, f"{ns}warrant", F.when(good, F.col("warrant.type")))]
    for key, edge, node_type, members in (("sources", "source", "Source", SOURCE), ("verified", "review", "Review", REVIEW), ("attachments", "hasAttachment", "Attachment", ATTACHMENT)):
        if not _has(items, key):
            continue
        there = items.select(F.explode(key).alias("x")).select("x.*").columns

        def nodes(x: Column, n: Column) -> Column:
            node = F.concat(s, F.lit(f"#{edge.removeprefix('has').lower()}-"), (n + 1).cast("string"))
            told = [_literal(node, name(p), F.coalesce(x[m], F.lit(licence).cast("string")) if m == "license" else x[m], datatype) for m, p, datatype in members if m in there]
            return F.array_compact(F.array(_edge(s, ns + edge, node), _edge(node, RDF_TYPE, F.lit(ns + node_type)), *told))

        listed.append(F.flatten(F.coalesce(F.transform(key, nodes), F.array().cast(f"array<array<{QUAD}>>"))))
    quads = own.select(F.explode(F.array_compact(F.concat(F.array(*one), *listed))).alias("q")).select("q.*")
    return reduce(DataFrame.unionByName, [quads, *_linked(own, index, ns, mentions, citations)]).distinct()


def _keyed(key: str) -> Column:
    return F.transform(f"`{key}`", lambda x: F.struct(F.lit(key).alias("key"), x.alias("target")))


def _linked(own: DataFrame, index: DataFrame, ns: str, mentions: DataFrame | None, citations: DataFrame | None) -> list[DataFrame]:
    name = lambda p: p if ":" in p else ns + p
    none = F.lit(None).cast("string")
    rows = lambda df, s, p, o: df.select(F.col(s).alias("s"), p.alias("p"), F.col(o).alias("o"), F.lit("iri").alias("kind"), none.alias("datatype"), none.alias("lang"))
    out = []
    keys = [k for k, *_ in RELATIONS if k in own.columns]
    if keys:
        authored = own.select("type", "__iri", F.explode(F.flatten(F.array(*[F.coalesce(_keyed(k), F.array().cast("array<struct<key: string, target: string>>")) for k in keys]))).alias("l"))
        found = resolved(authored.select("type", "__iri", "l.key", "l.target"), index, "target").where(~F.col("key").isin(*SEMANTIC) | ((F.col("type") != "cluster") & (F.col("target_type") != "cluster")))
        there = F.create_map(*[F.lit(x) for k in keys for x in (k, name(LINKS[k][0]))])
        symmetric = {k for k, _, both, *_ in RELATIONS if both}
        back = {k: name(LINKS[k][0] if k in symmetric else LINKS[k][1]) for k in keys if k in symmetric or LINKS[k][1]}
        out.append(rows(found, "__iri", F.element_at(there, F.col("key")), "target"))
        if back:
            turned = F.create_map(*[F.lit(x) for pair in back.items() for x in pair])
            out.append(rows(found.where(F.col("key").isin(*back)), "target", F.element_at(turned, F.col("key")), "__iri"))
    nests = [own.select("__iri", F.explode(c).alias("parent")) for c in ("clusters",) if c in own.columns]
    nests += [own.where("type = 'cluster'").select("__iri", F.explode("broader").alias("parent"))] if "broader" in own.columns else []
    out += [rows(resolved(df, index, "parent"), "parent", F.lit(f"{SKOS}member"), "__iri") for df in nests]
    if mentions is not None:
        out.append(rows(resolved(resolved(mentions.select("source", "target"), index, "source").drop("target_type"), index, "target"), "source", F.lit(f"{ns}mentions"), "target"))
    if citations is not None:
        cited = resolved(citations.select("source", "see_also", "peer").dropna(), index, "source")
        out += [rows(cited, "source", F.lit(f"{RDFS}seeAlso"), "see_also"), rows(cited, "source", F.lit(f"{ns}peerOrigin"), "peer")]
    return out


def _escaped(c: Column) -> Column:
    """A literal's text; characters below U+0020 that have no escape of their own as four hexadecimal digits."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    for code in (x for x in range(32) if x not in (9, 10, 13)):
        c = F.replace(c, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return c


def _iri(c: Column) -> Column:
    for code in (*range(32), *map(ord, '<>"{}|^`\\')):
        if code != ord("\\"):
            c = F.replace(c, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit("<"), c, F.lit(">"))


def quad_lines(quads: DataFrame, graph: str | None = None) -> DataFrame:
    """(line) of each quad in canonical N-Quads, once, in code-point order over all partitions. Backslashes of IRIs come first, so that escapes stay."""
    iri = lambda c: _iri(F.replace(c, F.lit("\\"), F.lit("\\u005c")))
    text = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'))
    value = F.when(F.col("kind") == "iri", iri(F.col("o"))).when(F.col("lang").isNotNull(), F.concat(text, F.lit("@"), "lang")).otherwise(F.concat(text, F.lit("^^"), iri(F.col("datatype"))))
    end = F.lit(" ." if graph is None else f" <{graph}> .")
    return quads.select(F.concat(iri(F.col("s")), F.lit(" "), iri(F.col("p")), F.lit(" "), value, end).alias("line")).distinct().orderBy("line")
