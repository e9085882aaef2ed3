"""Folders of Markdown files with frontmatter: reading them as items and links, and writing line-based exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattix.operators.links import RELATIONS

FRONT = r"(?s)^﻿?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"
#: What the readers of frontmatter refuse: anchors, aliases, tags and merge keys.
REFUSED = r"(?m)^\s*(?:[\w-]+:|-)\s*[&*!]\S|^\s*<<\s*:"
#: Documents of more bytes are reported, not read.
MOST_BYTES = 1 << 20


def front_lines(text: Column) -> Column:
    return F.split(F.regexp_extract(text, FRONT, 1), "\r?\n")


def scalar(text: Column, key: str) -> Column:
    """A top-level scalar of the frontmatter as text, without quotes; null if it isn't there."""
    value = F.regexp_extract(F.regexp_extract(text, FRONT, 1), rf"(?m)^{key}:[ \t]+(\S[^\r\n]*?)[ \t]*$", 1)
    return F.when(value != "", F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2"))


def listed(text: Column, key: str) -> Column:
    """A top-level list of the frontmatter, in block form or in brackets."""
    front = F.concat(F.regexp_extract(text, FRONT, 1), F.lit("\n"))
    block = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]+-[ \t]+[^\n]*\n|-[ \t]+[^\n]*\n)+)", 1)
    flow = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\[([^\]]*)\]", 1)
    items = F.when(block != "", F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]+(\S[^\r\n]*?)[ \t]*$"), 1)).otherwise(F.split(flow, ","))
    return F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"""^(["'])(.*)\1$""", "$2")), lambda x: x != "")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(path, slug, front, body, type, title, description, status, tags, clusters, finding) of the .md files below a folder.

    slug is the file's name. finding says why a file can't be read: its size, no frontmatter, or a construct that isn't allowed there; its other columns are then null.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    front = F.regexp_extract("text", FRONT, 1)
    finding = F.when(F.octet_length("text") > MOST_BYTES, "too-large").when(~F.col("text").rlike(FRONT), "no-frontmatter").when(front.rlike(REFUSED), "refused-construct")
    good = lambda c: F.when(F.col("finding").isNull(), c)
    own = raw.withColumn("finding", finding).withColumn("slug", F.regexp_extract("path", r"([^/]+)\.md$", 1))
    text = F.col("text")
    return own.select("path", "slug", good(front).alias("front"), good(F.regexp_replace("text", FRONT, "")).alias("body"), *[good(scalar(text, k)).alias(k) for k in ("type", "title", "description", "status", "kind", "date")], good(listed(text, "tags")).alias("tags"), good(listed(text, "clusters")).alias("clusters"), "text", "finding")


def authored_links(items: DataFrame) -> DataFrame:
    """(source, key, target) of the link keys of the items' frontmatter."""
    keys = [r[0] for r in RELATIONS]

    def keyed(key: str) -> Column:
        return F.transform(listed(F.col("text"), key), lambda x: F.struct(F.lit(key).alias("key"), x.alias("target")))

    each = F.explode(F.flatten(F.array(*[keyed(k) for k in keys]))).alias("l")
    return items.where("finding is null").select(F.col("slug").alias("source"), each).select("source", "l.key", "l.target").distinct()


def mentions(items: DataFrame) -> DataFrame:
    """(source, key, target): mentions, of what the body links to by [text](target) or [[target]] outside fenced code; the target's last path part without .md."""
    prose = F.regexp_replace("body", r"(?s)(?:^|\n)(```|~~~).*?\n\1[^\n]*", "\n")
    found = F.concat(F.regexp_extract_all(prose, F.lit(r"(?<!!)\[[^\]\n]*\]\(([^)\s#]+)[^)]*\)"), 1), F.regexp_extract_all(prose, F.lit(r"\[\[([^\]|#\n]+)[^\]\n]*\]\]"), 1))
    target = F.regexp_extract("t", r"([^/]+?)(?:\.md)?/?$", 1)
    return items.where("finding is null").select(F.col("slug").alias("source"), F.explode(found).alias("t")).where(~F.col("t").rlike("^[a-z]+:")).select("source", F.lit("mentions").alias("key"), target.alias("target")).distinct()


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """Distinct lines in code-point order, in files that follow each other."""
    df.select(F.col(column).alias("value")).distinct().repartitionByRange("value").sortWithinPartitions("value").write.text(path)


def write_sharded(df: DataFrame, order: str, path: str, rows: int = 500) -> None:
    """JSON lines in folders shard=n of so many rows each, by the order of a unique column; numbered by partition offsets, so that no task sees all rows."""
    ordered = df.repartitionByRange(order).withColumn("__p", F.spark_partition_id())
    rank = ordered.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(order)))
    base = ordered.groupBy("__p").agg(F.count("*").alias("__n")).select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    rank.join(F.broadcast(base), "__p").withColumn("shard", F.expr(f"(__b + __r - 1) div {rows}")).drop("__p", "__r", "__b").write.partitionBy("shard").json(path)
