"""Typed links: the relation table, resolution with inverse and symmetric edges, and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Each authored key with its inverse, whether it is symmetric and transitive, and what composition makes of it.
RELATIONS = [
    ("related", "related", True, False, "advisory"),
    ("broader", "narrower", False, True, "none"),
    ("narrower", "broader", False, True, "none"),
    ("uses", "used-by", False, False, "soft"),
    ("requires", "required-by", False, True, "hard"),
    ("excludes", "excludes", True, False, "mutex"),
    ("derived-from", "derivation-of", False, True, "none"),
    ("contradicts", "contradicts", True, False, "warn-both"),
    ("supersedes", "superseded-by", False, True, "hide-superseded"),
    ("implements", "implemented-by", False, False, "none"),
    ("verifies", "verified-by", False, False, "none"),
    ("covers", "covered-by", False, False, "none"),
    ("blocked-by", "blocks", False, True, "none"),
    ("decided-by", "decides", False, False, "none"),
]


def relation_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELATIONS, "key string, inverse string, symmetric boolean, transitive boolean, combiner string")


def resolve(links: DataFrame) -> DataFrame:
    """(source, key, target, computed) of authored links and the inverse of each, one row an edge; authored wins over computed."""
    dim = F.broadcast(relation_table(links.sparkSession).select("key", "inverse"))  # 14 rows
    authored = links.select("source", "key", "target", F.lit(False).alias("computed"))
    turned = links.join(dim, "key").select(F.col("target").alias("source"), F.col("inverse").alias("key"), F.col("source").alias("target"), F.lit(True).alias("computed"))
    return authored.union(turned).groupBy("source", "key", "target").agg(F.min("computed").alias("computed"))


def dangling(links: DataFrame, items: DataFrame, slug: str = "slug") -> DataFrame:
    """Links whose target is no item."""
    return links.join(items.select(F.col(slug).alias("target")).distinct(), "target", "left_anti").select("source", "key", "target")


def prune(links: DataFrame, published: DataFrame, slug: str = "slug") -> DataFrame:
    """Links between published items."""
    own = published.select(F.col(slug).alias("slug")).distinct()
    return links.join(own.withColumnRenamed("slug", "source"), "source", "left_semi").join(own.withColumnRenamed("slug", "target"), "target", "left_semi").select("source", "key", "target")


def self_links(links: DataFrame) -> DataFrame:
    return links.where("source = target")


def incompatible(links: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(source, target, first, second) where both keys of a pair join the same two items."""
    dim = F.broadcast(links.sparkSession.createDataFrame(pairs, "first string, second string"))
    a = links.select("source", "target", F.col("key").alias("first")).distinct()
    b = links.select("source", "target", F.col("key").alias("second")).distinct()
    return a.join(dim, "first").join(b, ["source", "target", "second"]).select("source", "target", "first", "second")


def wrong_kind(links: DataFrame, kinds: DataFrame, keys: list[str]) -> DataFrame:
    """Links of some keys whose target is of another kind than the source; kinds has (slug, kind)."""
    own = links.where(F.col("key").isin(*keys)).join(kinds.withColumnsRenamed({"slug": "source", "kind": "own"}), "source")
    return own.join(kinds.withColumnsRenamed({"slug": "target", "kind": "other"}), "target").where("own != other").select("source", "key", "target")


def wiring(produces: DataFrame, consumes: DataFrame) -> DataFrame:
    """(producer, port, n_consumers), producers without a consumer with 0."""
    users = consumes.distinct().groupBy("port").agg(F.count("*").alias("n_consumers"))
    return produces.distinct().join(users, "port", "left").select("producer", "port", F.coalesce("n_consumers", F.lit(0)).alias("n_consumers"))


def missing_ports(produces: DataFrame, consumes: DataFrame) -> DataFrame:
    """(consumer, port) that nobody produces."""
    return consumes.distinct().join(produces.select("port").distinct(), "port", "left_anti").select("consumer", "port")


def sharers(cites: DataFrame) -> DataFrame:
    """(resource, n_items) of resources that more than one item cites."""
    return cites.distinct().groupBy("resource").agg(F.count("*").alias("n_items")).where("n_items > 1")


def sharing_pairs(cites: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n_shared) of items with at least so many resources in common.

    Only resources that are shared are joined. An item pair is emitted once for each resource, so a resource that very many items
    cite has to be left to sharers().
    """
    own = cites.select("item", "resource").distinct()
    shared = own.join(sharers(own).select("resource"), "resource", "left_semi")
    a, b = shared.select(F.col("item").alias("a"), "resource"), shared.select(F.col("item").alias("b"), "resource")
    return a.join(b, "resource").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= least)
