"""Readers of assistants' memory exports: rows of (id, title, text, tags, day, format), empty texts left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.sources.boards import column, date_of, read_table, words_of


def _rows(df: DataFrame, kind: str, id_: Column, text: Column, tags: Column, day: Column, title: Column | None = None) -> DataFrame:
    first = F.trim(F.left(F.split_part(F.trim(text), F.lit("\n"), F.lit(1)), F.lit(120)))
    none = F.array().cast("array<string>")
    named = F.coalesce(F.nullif(F.trim(title), F.lit("")), first) if title is not None else first
    return df.select(id_.cast("string").alias("id"), named.alias("title"), F.trim(text).alias("text"), F.coalesce(tags, none).alias("tags"), date_of(day).alias("day"), F.lit(kind).alias("format")).where("text != ''")


ONE_MEM0 = "struct<id: string, memory: string, data: struct<memory: string>, messages: array<struct<content: string>>, categories: array<string>, createdAt: string, created_at: string>"


def mem0(spark: SparkSession, path: str) -> DataFrame:
    """A list of memories or a page with results; the text is memory, data.memory or the messages."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<{ONE_MEM0}>")
    paged = F.from_json("value", f"struct<results: array<{ONE_MEM0}>>")["results"]
    m = raw.select(F.explode(F.when(F.col("value").rlike(r"^\s*\["), listed).otherwise(paged)).alias("m")).select("m.*")
    text = F.coalesce("memory", "data.memory", F.array_join("messages.content", "\n"))
    return _rows(m, "mem0", F.col("id"), text, F.col("categories"), F.coalesce("createdAt", "created_at"))


def letta(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema("id string, text string, tags array<string>, created_at string").json(path, multiLine=True)
    return _rows(d, "letta", F.col("id"), F.col("text"), F.col("tags"), F.col("created_at"))


def zep(spark: SparkSession, path: str) -> DataFrame:
    """Episodes by content or data, nodes by name and summary."""
    d = spark.read.schema("items array<struct<uuid: string, content: string, data: string, name: string, summary: string, createdAt: string, created_at: string>>").json(path, multiLine=True)
    m = d.select(F.explode("items").alias("m")).select("m.*")
    return _rows(m, "zep", F.col("uuid"), F.coalesce("content", "data", "summary"), F.lit(None).cast("array<string>"), F.coalesce("createdAt", "created_at"), F.coalesce("name", F.lit("")))


def notes_csv(spark: SparkSession, path: str) -> DataFrame:
    d = read_table(spark, path)
    title = column(d, "title", "name")
    text = F.coalesce(column(d, "body", "content", "text", "memory"), title)
    return _rows(d, "csv", title, text, words_of(column(d, "tags", "labels"), ";,"), column(d, "date", "created"), title)


READERS = {"mem0": mem0, "letta": letta, "zep": zep, "csv": notes_csv}


def read_memories(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return READERS[kind](spark, path)
