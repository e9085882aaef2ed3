"""Checks of items. Each gives findings: (code, severity, slug, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.functions import scalars, text

SCHEMA = "code string, severity string, slug string, message string"


def finding(df: DataFrame, code: str, severity: str, where: Column, message: Column) -> DataFrame:
    return df.where(F.coalesce(where, F.lit(False))).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("slug"), message.cast("string").alias("message"))


def bad_slugs(items: DataFrame) -> DataFrame:
    good = F.col("slug").rlike("^[a-z0-9]+(-[a-z0-9]+)*$") & (F.char_length("slug") <= 64)
    return finding(items, "slug", "error", ~good, F.lit("not a slug"))


def personal_data(items: DataFrame, body: str = "body") -> DataFrame:
    n = F.size(text.emails(F.col(body))) + F.size(text.phones(F.col(body)))
    return finding(items, "personal-data", "error", n > 0, n)


def injected(items: DataFrame, body: str = "body") -> DataFrame:
    phrases = text.injection_phrases(F.col(body))
    return finding(items, "injection", "error", (F.size(phrases) > 0) | text.hidden_characters(F.col(body)), F.array_join(phrases, ","))


def encoded_blobs(items: DataFrame, body: str = "body") -> DataFrame:
    return finding(items, "encoded", "warning", F.col(body).rlike("[A-Za-z0-9+/]{256,}={0,2}|(?:[0-9a-fA-F]{2}){128,}"), F.lit("long encoded run"))


def secrets(items: DataFrame, body: str = "body") -> DataFrame:
    n = F.size(text.secrets(F.col(body)))
    return finding(items, "secret", "error", n > 0, n)


def combining(items: DataFrame, body: str = "body") -> DataFrame:
    return finding(items, "combining", "error", F.col(body).rlike(r"\p{M}{257,}"), F.lit("too many marks on a character"))


def sections_lacking(items: DataFrame, parts: DataFrame, required: list[str]) -> DataFrame:
    """parts has (slug, title) of the items' sections."""
    have = parts.groupBy("slug").agg(F.collect_set(F.when(F.col("title").isin(required), F.col("title"))).alias("have"))
    missing = text.required_missing(F.coalesce("have", F.array().cast("array<string>")), required)
    return finding(items.join(have, "slug", "left"), "section", "error", F.size(missing) > 0, F.array_join(missing, ","))


def few_sources(items: DataFrame, cites: DataFrame, least: int, machine: Column) -> DataFrame:
    """Items written by a machine that cite fewer than so many sources that are not machine-written items themselves. cites has (slug, resource)."""
    written = items.where(machine).select("slug")
    outside = cites.join(written.withColumnRenamed("slug", "resource"), "resource", "left_anti").distinct().groupBy("slug").agg(F.count("*").alias("n"))
    return finding(items.where(machine).join(outside, "slug", "left"), "sources", "warning", F.coalesce("n", F.lit(0)) < least, F.coalesce("n", F.lit(0)))


def colliding_names(files: DataFrame, path: str = "slug") -> DataFrame:
    """Files whose names differ in case only, and names that can't be used everywhere."""
    folded = files.withColumn("folded", scalars.fold_case(F.col(path)))
    twice = folded.groupBy("folded").agg(F.count_distinct(path).alias("n")).where("n > 1").drop("n")
    collide = finding(folded.join(twice, "folded", "left_semi").withColumn("slug", F.col(path)), "name-case", "error", F.lit(True), F.col("folded"))
    bad = scalars.portable_name(F.element_at(F.split(path, "/"), -1))
    return collide.union(finding(files.withColumn("slug", F.col(path)), "name", "error", bad.isNotNull(), bad))


def provenance(items: DataFrame) -> DataFrame:
    """Items of a machine's origin need the agent and its model. items has (slug, origin, agent, model)."""
    lacking = F.col("origin").startswith("ai") & (F.col("agent").isNull() | F.col("model").isNull())
    return finding(items, "provenance", "error", lacking, F.lit("agent and model are needed"))


RULES = "type string, key string, required boolean, allowed array<string>, pattern string, least int, most int"


def schema(items: DataFrame, values: DataFrame, rules: DataFrame) -> DataFrame:
    """What items break of a schema: E202 a key that their type has to have, E203 a value that isn't allowed, E204 one of another pattern or length, E206 a slug of several items, E207 (a warning) a key that no rule names.

    items has (slug, type), values (slug, key, value) with a row for each value, rules (RULES): what they leave null isn't asked for. Lengths are in code points.
    """
    typed = items.select("slug", "type").distinct()
    need = typed.join(F.broadcast(rules.where("required").select("type", "key").distinct()), "type")  # a schema is a short list
    lacking = need.join(values.where("value is not null").select("slug", "key").distinct(), ["slug", "key"], "left_anti")
    stated = values.where("value is not null").join(typed, "slug")
    ruled = stated.join(F.broadcast(rules), ["type", "key"])
    said = F.concat_ws(": ", "key", "value")
    length = F.char_length("value")
    shape = (F.col("pattern").isNotNull() & ~F.expr("coalesce(value rlike pattern, true)")) | (length < F.col("least")) | (length > F.col("most"))
    twice = items.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1")
    unknown = stated.join(F.broadcast(rules.select("type", "key").distinct()), ["type", "key"], "left_anti").select("slug", "key").distinct()
    return all_of(
        finding(lacking, "E202", "error", F.lit(True), F.col("key")), finding(ruled, "E203", "error", F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.col("value")), said),
        finding(ruled, "E204", "error", shape, said), finding(twice, "E206", "error", F.lit(True), F.col("n")), finding(unknown, "E207", "warning", F.lit(True), F.col("key")),
    )


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).select("code", "severity", "slug", "message")


def summary(findings: DataFrame) -> DataFrame:
    """(severity, code, n)."""
    return findings.groupBy("severity", "code").agg(F.count("*").alias("n"))
