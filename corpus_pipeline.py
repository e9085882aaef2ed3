"""From raw documents to a mixed training corpus: each stage works on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.llm import language_mix, line_dedup, ngram_join, pfair_mix, phrase_index
from lattix.llm.scratch import drop_since, made, written

#: Those of documents; stages drop any other.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Up to so many ids are sent to every executor.
BROADCAST_IDS = 2_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the languages that the documents name, and drops texts without one that makes up MIN_SHARE of them; null and empty texts go."""
    return language_mix.accepted(docs, language_mix.train(docs)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat an earlier one, of any document; texts of which no word is left go."""
    left = line_dedup.dedup_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _small(ids: DataFrame) -> DataFrame:
    """For a join: sent to all executors if that is few rows, else shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _clash(keyed: DataFrame) -> bool:
    """Whether two texts have one __key, as another hash of theirs shows."""
    check = F.xxhash64(F.lit("check"), "text")
    return not keyed.groupBy("__key").agg((F.min(check) != F.max(check)).alias("clash")).where("clash").isEmpty()


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that with the least id, rows without an id last. Rows without a word are alone; of those with one id and text one stays."""
    start = made()
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    for seed in range(3):
        rows = docs.where(worded).withColumn("__key", F.xxhash64(F.lit(seed), "text")).withColumn("__none", F.col("doc_id").isNull()).withColumn("__id", F.coalesce("doc_id", F.lit(0)))
        if not _clash(rows):
            break
    else:
        raise ValueError("keys of different texts met under three seeds")
    row = ["__none", "__id", "__key"]
    found = ngram_join.similar_components(rows.select(F.col("__key").alias("doc_id"), "text")).select(F.col("doc_id").alias("__key"), "component_id").distinct()
    least = rows.groupBy("__key").agg(F.min(F.struct("__none", "__id")).alias("least")).join(found, "__key")
    first = written(least.groupBy("component_id").agg(F.min(F.struct("least.__none", "least.__id", "__key")).alias("row")).select("row.*"), "first")
    kept = rows.join(_small(first), row, "left_semi")
    twice = written(kept.groupBy(*row).count().where("count > 1").select(*row), "twice")
    drop_since(spark, start, first, twice)
    blank = docs.where(~worded)
    kept = kept if twice.isEmpty() else kept.join(_small(twice), row, "left_anti").unionByName(kept.join(_small(twice), row, "left_semi").dropDuplicates(row))
    alone = blank.where("doc_id is null").unionByName(blank.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
    return kept.select(*COLUMNS).unionByName(alone.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a window of ten words with a benchmark item: each row by its own text, with an id or without, and whatever other rows have its id."""
    start = made()
    for seed in range(3):
        keyed = docs.withColumn("__key", F.xxhash64(F.lit(seed), "text"))
        found = phrase_index.contamination(keyed.select("__key", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__key")
        tainted = written(found.where("contaminated").select(F.col("doc_id").alias("__key")).distinct(), "tainted")
        hit = keyed.join(_small(tainted), "__key", "left_semi")
        if not _clash(hit):
            break
    else:
        raise ValueError("keys of different texts met under three seeds")
    drop_since(spark, start, tainted)
    return keyed.join(_small(tainted), "__key", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Orders all documents so that sources come by the square root of their sizes; adds block, slot and position."""
    return pfair_mix.mix_sources(docs.select(*COLUMNS))


STAGES = [("language_id", language_id), ("dedup_lines", dedup_lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix)]

#: Models and schedules are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        start = made()
        docs = written(stage(spark, docs, sf_dir), name)
        drop_since(spark, start, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
