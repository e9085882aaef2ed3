"""A generated collection of linked Markdown items, of any size, by arithmetic alone: no two runs differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "agent pattern memory gate review cluster source port ledger claim lesson episode task digest anchor shape query link node board".split()
HEADINGS = ("Intent", "Context & Forces", "Structure", "Consequences & Trade-offs", "Related Patterns")


def _paragraph(offset: int, words: int) -> Column:
    listed = F.array(*[F.lit(w) for w in WORDS])
    picked = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.get(listed, ((F.col("n") * 7 + offset * 13 + i * 3) % len(WORDS)).cast("int")))
    text = F.array_join(picked, " ")
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text)), F.lit("."))


def generate(spark: SparkSession, items: int, paragraph_words: int = 40) -> DataFrame:
    """(slug, type, kind, title, description, date, clusters, tags, related, body) of so many items: each has five headings with two paragraphs, two relations and one cluster."""
    other = lambda k: F.concat(F.lit("item-"), ((F.col("n") + k) % items + 1).cast("string"))
    number = (F.col("n") + 1).cast("string")
    parts: list[Column] = [F.lit("# Item "), number, F.lit("\n\n")]
    for h, heading in enumerate(HEADINGS):
        parts += [F.lit(f"## {heading}\n\n"), _paragraph(h + 1, paragraph_words), F.lit("\n\n"), _paragraph(h + 20, paragraph_words), F.lit("\n\n")]
    parts += [F.lit("See [the next]("), other(1), F.lit(".md).\n")]
    return spark.range(items).withColumnRenamed("id", "n").select(
        F.concat(F.lit("item-"), number).alias("slug"), F.lit("concept").alias("type"), F.lit("pattern").alias("kind"), F.concat(F.lit("Item "), number).alias("title"), _paragraph(0, 12).alias("description"), F.lit("2026-01-01").alias("date"),
        F.array(F.lit("all-items")).alias("clusters"), F.array(F.lit("agents"), F.lit("patterns")).alias("tags"), F.array(other(1), other(7)).alias("related"), F.concat(*parts).alias("body"),
    )
