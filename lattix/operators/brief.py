"""The brief of a composition: relations of its members, what it lacks, and what there is to do. Each is a table with a row for each entry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.operators import links
from lattix.operators.order import dependency_order

#: Keys whose targets come before their sources.
BEFORE = ("requires", "broader", "derived-from")


def relations(authored: DataFrame, listed: DataFrame, members: DataFrame) -> DataFrame:
    """(source, key, target, origin, scope) of the edges between listed items that touch a member: origin is authored, inverse or symmetric, scope inside if both ends are members, else outside.

    authored has (source, key, target), the others a column slug. An edge that is both authored and computed is authored.
    """
    edges = links.resolve(links.prune(authored, listed))
    own = members.select("slug").distinct()
    inside = lambda c: own.select(F.col("slug").alias(c), F.lit(True).alias(f"{c}_in"))
    symmetric = [key for key, inverse, *_ in links.RELATIONS if key == inverse]
    origin = F.when(~F.col("computed"), "authored").when(F.col("key").isin(symmetric), "symmetric").otherwise("inverse")
    known = edges.join(inside("source"), "source", "left").join(inside("target"), "target", "left").where("source_in or target_in")
    return known.select("source", "key", "target", origin.alias("origin"), F.when(F.col("source_in") & F.col("target_in"), "inside").otherwise("outside").alias("scope"))


def _entries(rows: DataFrame, kind: str, slug: str | Column, target: str | Column | None) -> DataFrame:
    target = F.lit(None).cast("string") if target is None else F.col(target) if isinstance(target, str) else target
    return rows.select(F.lit(kind).alias("kind"), (F.col(slug) if isinstance(slug, str) else slug).alias("slug"), target.alias("target")).distinct()


def gaps(related: DataFrame, members: DataFrame, unmet: DataFrame, instant: str) -> DataFrame:
    """(kind, slug, target) of what the members lack, of eight kinds.

    related is what relations() gives; members has (slug, sources, stale_after, status), sources telling whether there are any; unmet has (source, target), members and ports that no member
    produces. stale_after is compared as text with the instant; null is never stale.
    """
    out = lambda key: related.where(F.col("key") == key)
    leaving = lambda key: out(key).join(members.select(F.col("slug").alias("source")), "source", "left_semi").where("scope = 'outside'")
    replaced = out("supersedes").where("origin = 'authored' and scope = 'outside'").join(members.select(F.col("slug").alias("target")), "target", "left_semi")
    against = out("contradicts").where("origin = 'authored' and scope = 'inside'")
    once = against.groupBy(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).agg(F.min(F.struct("source", "target")).alias("e")).select("e.*")
    return reduce(DataFrame.union, [
        _entries(leaving("uses").where("origin = 'authored'"), "uses-not-selected", "source", "target"),
        _entries(leaving("related"), "related-not-selected", "source", "target"),
        _entries(unmet.join(members.select(F.col("slug").alias("source")), "source", "left_semi"), "port-without-producer", "source", "target"),
        _entries(members.where(~F.coalesce("sources", F.lit(False))), "no-sources", "slug", None),
        _entries(members.where(F.col("stale_after").cast("string") < instant), "stale", "slug", None),
        _entries(members.where("status = 'deprecated'"), "deprecated", "slug", None),
        _entries(replaced, "replaced-outside", "target", "source"),
        _entries(once, "contradiction", "source", "target"),
    ])


def checklist(related: DataFrame, members: DataFrame, lacking: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(kind, place, slug, target) of what there is to do, of six kinds; place is that of the dependency order for adopt, null for others.

    lacking is what gaps() gives, conflicts has (a, b). Members that wait on each other have places too.
    """
    own = members.select("slug").distinct()
    waits = related.where(F.col("key").isin(*BEFORE) & (F.col("scope") == "inside"))
    placed = dependency_order(waits, own, "slug").select(F.lit("adopt").alias("kind"), "place", F.col("node").alias("slug"), F.lit(None).cast("string").alias("target"))
    authored = lambda key, member: related.where((F.col("key") == key) & (F.col("origin") == "authored")).join(own.withColumnRenamed("slug", member), member, "left_semi")
    rest = reduce(DataFrame.union, [
        _entries(lacking.where("kind = 'port-without-producer'"), "provide-port", "slug", "target"),
        _entries(lacking.where("kind = 'contradiction'"), "decide", "slug", "target"),
        _entries(authored("verifies", "target"), "verify", "target", "source"),
        _entries(authored("blocked-by", "source"), "unblock", "source", "target"),
        _entries(conflicts, "resolve", "a", "b"),
    ])
    return placed.unionByName(rest.select("kind", F.lit(None).cast("long").alias("place"), "slug", "target"))
