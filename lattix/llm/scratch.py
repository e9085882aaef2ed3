"""Tables written to the folder that the cluster shares, to cut lineage.

A written table outlives the executors that made it, so a job that loses some of
them rereads it rather than computing everything before it again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is written: shuffle files go when the write ends, and a batch sent to Python is of so many bytes at most.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one is made only where that is unset, as in tests."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        jvm = context._jvm.System
        folder = jvm.getProperty("lattix.scratch") or f"file://{tempfile.mkdtemp(prefix='lattix-')}"
        jvm.setProperty("lattix.scratch", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lattix/{name}-{uuid.uuid4().hex}"


#: Folders of the tables that this driver has written.
_made: list[str] = []


def made() -> int:
    """How many tables have been written so far, for drop_since()."""
    return len(_made)


def drop_since(spark: SparkSession, first: int, *kept: DataFrame) -> None:
    """Removes the tables written since made() gave first, but for those kept. Nothing lazy that reads them may be left."""
    keep = {_folder(f) for df in kept for f in df.inputFiles()}
    gone = [p for p in _made[first:] if p.rsplit("/", 1)[1] not in keep]
    _made[first:] = [p for p in _made[first:] if p not in gone]
    _delete(spark, gone)


def _folder(file: str) -> str:
    return file.rsplit("/", 2)[1]


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Removes tables of written() that no later result reads."""
    for df in tables:
        _delete(df.sparkSession, list({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def numbered(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The rows, written, with number: 0, 1, 2 and so on, by partition and in the order within it; and how many they are."""
    kept = written(rows.withColumn("__id", F.monotonically_increasing_id()), name)
    part = F.shiftright("__id", 33)
    sizes = sorted(kept.groupBy(part.alias("part")).count().collect())  # a row for each partition
    first, total = {}, 0
    for p, count in sizes:
        first[p], total = total, total + count
    at = F.element_at(F.create_map(*(F.lit(x) for pair in first.items() for x in pair)), part) if first else F.lit(0)
    return kept.withColumn("number", (at + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__id"), total
