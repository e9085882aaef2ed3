"""Files of exchange: quads, selections, query sets, traces, manifests, packs and comparisons of dumps."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattix.functions.text import ascii_lower, numbered_slugs, slugify
from lattix.operators.ledger import trailers
from lattix.operators.rdf import literal, parse_lines
from lattix.sources.boards import read_table


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples or N-Quads files as (s, p, o, kind, datatype, lang, g)."""
    return parse_lines(spark.read.text(path))


def union_of_dumps(dumps: dict[str, DataFrame]) -> DataFrame:
    """(line, origins) of several nodes' dumps (column value), each line once with the nodes that have it."""
    every = None
    for origin, df in dumps.items():
        own = df.select(F.col("value").alias("line"), F.lit(origin).alias("origin")).where(F.trim("line") != "")
        every = own if every is None else every.union(own)
    return every.groupBy("line").agg(F.array_sort(F.collect_set("origin")).alias("origins"))


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """(slug, decision, reason) of a tab-separated selection; of a slug's lines the first in the file counts."""
    d = read_table(spark, path, sep="\t").withColumn("__n", F.monotonically_increasing_id())
    first = d.groupBy("slug").agg(F.min_by(F.struct("decision", *(["reason"] if "reason" in d.columns else [])), "__n").alias("x"))
    return first.where("slug is not null").select("slug", "x.*")


def read_queries(spark: SparkSession, queries: str, qrels: str) -> tuple[DataFrame, DataFrame]:
    """(qid, text) and the gold (qid, id) of a query set: JSON lines with _id and text, and tab-separated judgements with a score over 0."""
    q = spark.read.schema("_id string, text string").json(queries).select(F.col("_id").alias("qid"), "text")
    g = spark.read.csv(qrels, sep="\t", header=True)
    return q, g.where(F.col("score").cast("int") > 0).select(F.col("`query-id`").alias("qid"), F.col("`corpus-id`").alias("id"))


# An episode's members as traces name them, and its outcomes.
TRACE_MEMBERS = ("actor", "body", "ended", "outcome", "started", "title")
OUTCOMES = ("success", "partial", "failure")
USAGE = ("cost_usd", "estimate", "model", "tokens_in", "tokens_out")
KEPT = "x-trace-"


def episodes_of(records: DataFrame) -> DataFrame:
    """Episodes of traces (a column record, a map of strings): actor, body, ended, outcome, started, title, usage, a map, and rest, what is neither, by lower-case names after x-trace-.

    A trace without started is none. An outcome that isn't known, or is missing, is partial. Without a title an episode is called after its start.
    """
    member = {n: F.try_element_at("record", F.lit(n)) for n in TRACE_MEMBERS}
    outcome = F.when(member["outcome"].isin(*OUTCOMES), member["outcome"]).otherwise("partial")
    title = F.coalesce(member["title"], F.concat(F.lit("Agent run "), member["started"]))
    kept = F.map_filter("record", lambda k, v: ~k.isin(*TRACE_MEMBERS, *USAGE))
    name = lambda k: F.regexp_replace(F.regexp_replace(F.lower(k), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    rest = F.filter(F.transform(F.map_entries(kept), lambda e: F.struct(F.concat(F.lit(KEPT), name(e["key"])).alias("key"), e["value"].alias("value"))), lambda e: e["key"] != KEPT)
    first = F.filter(rest, lambda e, i: ~F.exists(F.slice(rest, 1, i), lambda x: x["key"] == e["key"]))
    own = {**member, "outcome": outcome, "title": F.trim(F.regexp_replace(title, r"\s+", " "))}
    return records.where(member["started"].isNotNull()).select(*[own[n].alias(n) for n in TRACE_MEMBERS], F.map_filter("record", lambda k, v: k.isin(*USAGE)).alias("usage"), F.map_from_entries(first).alias("rest"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files below a folder; path is relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index(F.col("path"), path.rstrip("/").rpartition("/")[2] + "/", -1)
    return files.select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def check_manifest(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, verdict) of what is absent, differs, or isn't listed."""
    both = listed.select("path", F.col("sha256").alias("a")).join(found.select("path", F.col("sha256").alias("b")), "path", "full")
    verdict = F.when(F.col("b").isNull(), "absent").when(F.col("a").isNull(), "unlisted").when(F.col("a") != F.col("b"), "differs")
    return both.withColumn("verdict", verdict).where("verdict is not null").select("path", "verdict")


def crosswalk(df: DataFrame, table: DataFrame, key: str, columns: list[str], none: str = "none") -> DataFrame:
    """df with columns of another table by a key, as text, and none where it has no row."""
    found = table.select(key, *[F.col(c).cast("string").alias(c) for c in columns])
    return df.join(found, key, "left").withColumns({c: F.coalesce(c, F.lit(none)) for c in columns})


def commitment(ids: DataFrame, column: str) -> DataFrame:
    """One row (digest, n) of a set of ids: the SHA-256 of all, in order, each with a line end. A SHA-256 is a chain, so the ids alone pass one task, as a stream."""

    def digest(batches):
        total, n = hashlib.sha256(), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total.update(f"{x}\n".encode())
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.hexdigest()]), pa.array([n], pa.int64())], ["digest", "n"])

    ordered = ids.select(F.col(column).cast("string").alias("id")).where("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id")
    return ordered.coalesce(1).mapInArrow(digest, "digest string, n long")


def listing(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """(section, line) of a plain listing for readers that are machines: a line for each item with its address and description, under the title of the first of its clusters that is listed first, else under Other.

    items has (slug, title, description, iri, cluster), clusters (slug, title). Titles and descriptions are put on one line, and what could open a link is escaped.
    """
    one = lambda c: F.trim(F.regexp_replace(c, r"[\s\x{85}\x{2028}\x{2029}]+", " "))
    safe = lambda c: F.regexp_replace(one(c), r"([\\\[\](])", r"\\$1")
    said = F.when(F.coalesce("description", F.lit("")) == "", F.col("title")).otherwise(F.col("description"))
    own = items.join(clusters.select(F.col("slug").alias("cluster"), one(F.col("title")).alias("section")), "cluster", "left")
    return own.select(F.coalesce("section", F.lit("Other")).alias("section"), F.concat(F.lit("- ["), safe(F.col("title")), F.lit("]("), "iri", F.lit("): "), safe(said)).alias("line"))


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """(sha, parents, committed_at, author, author_email, tag, message, trailers) of git log written with the format %H%x1f%P%x1f%cI%x1f%an%x1f%ae%x1f%D%x1f%B%x1e.

    committed_at is the instant in UTC and tag the greatest v tag; addresses are in lower case.
    """
    raw = spark.read.option("lineSep", "\x1e").text(path).select(F.split(F.regexp_replace("value", r"^\s+", ""), "\x1f", 7).alias("f")).where(F.size("f") == 7)
    part = lambda i: F.get("f", F.lit(i))
    tags = F.filter(F.transform(F.split(part(5), ", "), lambda x: F.regexp_replace(x, "^tag: ", "")), lambda x: x.startswith("v"))
    when = F.date_format(F.to_utc_timestamp(F.try_to_timestamp(part(2)), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return raw.select(
        part(0).alias("sha"), F.filter(F.split(part(1), " "), lambda x: x != "").alias("parents"), when.alias("committed_at"), part(3).alias("author"), ascii_lower(part(4)).alias("author_email"),
        F.array_max(tags).alias("tag"), part(6).alias("message"), trailers(part(6)).alias("trailers"),
    )


def packs(items: DataFrame, text: str = "text") -> DataFrame:
    """(cluster, n_members, text, lock) of each cluster's members in order of their slugs; items has (slug, clusters, text)."""
    each = items.select(F.explode("clusters").alias("cluster"), "slug", text)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slug", text))), lambda x: F.concat(F.lit("# "), x["slug"], F.lit("\n"), x[text])), "\n\n")
    return each.groupBy("cluster").agg(F.count("*").alias("n_members"), whole.alias("text")).withColumn("lock", F.sha2("text", 256))


def install_plan(new: DataFrame, installed: DataFrame) -> DataFrame:
    """(cluster, action) of packs against those installed, by their locks: new, updated, unchanged or removed."""
    both = new.select("cluster", F.col("lock").alias("a")).join(installed.select("cluster", F.col("lock").alias("b")), "cluster", "full")
    return both.select("cluster", F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("updated").alias("action"))


def mutual_peers(edges: DataFrame) -> DataFrame:
    """(a, b) of nodes that name each other."""
    pairs = edges.where("source != target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "source").distinct()
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 2").select("a", "b")


def citations(urls: DataFrame, peers: DataFrame, url: str = "url") -> DataFrame:
    """urls with the peer whose base is the longest prefix of each. Bases are joined by equality with a url's cuts at slashes, not by comparing all with all."""
    cut = F.split(F.regexp_replace(url, "[?#].*$", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(3), F.greatest(F.size(cut), F.lit(3))), lambda i: F.array_join(F.slice(cut, F.lit(1), i), "/"))
    keyed = urls.withColumn("__i", F.monotonically_increasing_id())
    own = peers.select(F.regexp_replace("base", "/+$", "").alias("__b"), F.col("peer"))
    met = keyed.select("__i", F.explode(prefixes).alias("__b")).join(own, "__b").groupBy("__i").agg(F.max_by("peer", F.length("__b")).alias("peer"))
    return keyed.join(met, "__i").drop("__i")


def turtle(triples: DataFrame, is_literal: Column) -> DataFrame:
    """(block) of each subject's triples in Turtle, with full IRIs."""
    o = F.when(is_literal, literal(F.col("o"))).otherwise(F.concat(F.lit("<"), "o", F.lit(">")))
    lines = triples.select("s", F.concat(F.lit("<"), "p", F.lit("> "), o).alias("line")).distinct()
    return lines.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list("line")), " ;\n    ").alias("l")).select(F.concat(F.lit("<"), "s", F.lit("> "), "l", F.lit(" .")).alias("block"))


def json_ld(triples: DataFrame) -> DataFrame:
    """(json) of each subject as a node object, its predicates as arrays of values in order."""
    values = triples.distinct().groupBy("s", "p").agg(F.array_sort(F.collect_list("o")).alias("v"))
    node = values.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "v")))).alias("m"))
    head = F.regexp_replace(F.to_json(F.struct(F.col("s").alias("@id"))), r"\}$", ",")
    return node.select(F.concat(head, F.expr("substring(to_json(m), 2)")).alias("json"))


def thesaurus(triples: DataFrame) -> DataFrame:
    """(concept, label, broader, top) of a vocabulary's triples (skos:prefLabel, skos:broader): the least label, the least broader concept, and whether it has none."""
    concepts = triples.where("p = 'rdf:type' and o = 'skos:Concept'").select(F.col("s").alias("concept")).distinct()
    least = lambda p, name: triples.where(F.col("p") == p).groupBy(F.col("s").alias("concept")).agg(F.min("o").alias(name))
    return concepts.join(least("skos:prefLabel", "label"), "concept", "left").join(least("skos:broader", "broader"), "concept", "left").withColumn("top", F.col("broader").isNull())


def adopted(files: DataFrame) -> DataFrame:
    """(path, slug, title) of bare Markdown files: the first heading or the file's name as title, slugs numbered in order of paths. files has (path, text)."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    heading = F.nullif(F.regexp_extract("text", r"(?m)^#\s+(\S.*?)\s*#*\s*$", 1), F.lit(""))
    titled = files.select("path", F.left(F.coalesce(heading, stem), F.lit(120)).alias("title")).withColumn("base", slugify(F.col("title")))
    return numbered_slugs(titled, "base", "path").select("path", "slug", "title")


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")
