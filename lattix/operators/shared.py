"""Cutting the lineage of loops by reliable checkpoints in the folder that the cluster shares, and numbers along a whole order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _folder(context) -> str:
    """The session's checkpoint folder; one of its own is set only where none is."""
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='lattix-')}")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint, which survives lost executors; a folder of one's own is set only where none is."""
    _folder(df.sparkSession.sparkContext)
    return df.checkpoint()


class Scratch:
    """Written tables of one operation. Unlike a checkpoint, which hands on an estimate that joins square in each round, a table is read with its true size, so small ones are broadcast."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def folder(self) -> str:
        """The name of a new folder there, for tables and files."""
        return f"{_folder(self.spark.sparkContext)}/tables/{uuid.uuid4().hex}"

    def cut(self, df: DataFrame) -> DataFrame:
        """The same rows, read back from a table in the folder that the cluster shares."""
        path = self.folder()
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """df as the last table; all others go."""
        kept, paths = self.cut(df), self.paths[:-1]
        for path in (self.spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths):
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []
        return kept


def numbered(df: DataFrame, *order: str, running: str | None = None) -> DataFrame:
    """The rows with number, 0, 1, 2 and so on in the order of the columns named, and running, the sum of a column up to and with each row, if one is named.

    Rows are dealt by ranges of the order; what comes before a range is added from a count, and a sum, for each partition.
    """
    kept = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    amount = F.coalesce(F.sum(running), F.lit(0)).cast("long") if running else F.lit(0).cast("long")
    sizes = sorted(tuple(r) for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n"), amount.alias("amount")).collect())  # a row for each partition
    first, counted, summed = [], 0, 0
    for p, n, a in sizes:
        first.append((p, counted, summed))
        counted, summed = counted + n, summed + a
    table = F.broadcast(df.sparkSession.createDataFrame(first, "__part long, __first long, __sum long"))
    own = kept.withColumn("__part", part).join(table, "__part")
    out = own.withColumn("number", F.col("__first") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    if running:
        out = out.withColumn("running", F.col("__sum") + F.sum(running).over(Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("__id", "__part", "__first", "__sum")
