"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.scratch import drop, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns vertex and root for every vertex of an edge; root is the smallest vertex that edges lead to.

    Each round hooks every vertex to its smallest neighbour below it, follows those links to
    their ends by doubling, and goes on with the edges between ends. Hooking is a grouped
    minimum, which Spark combines before its shuffle, and the links are spread by joins that
    adaptive execution can split: no vertex's neighbours are ever gathered. Null ends and
    loops are ignored; repeated edges count once; no edges give no rows.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    rest = written(ends.where("lo < hi").distinct(), "edges")
    label = rest.select(F.explode(F.array("lo", "hi")).alias("vertex")).distinct().withColumn("root", F.col("vertex"))
    while not rest.isEmpty():
        hook = written(rest.groupBy(F.col("hi").alias("from")).agg(F.min("lo").alias("to")), "hook")
        while True:
            ahead = hook.select(F.col("from").alias("to"), F.col("to").alias("next"))
            longer = written(hook.join(ahead, "to", "left").select("from", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hook")
            drop(hook)
            hook = longer.drop("moved")
            if longer.where("moved").isEmpty():
                break
        renamed = [hook.select(F.col("from").alias(c), F.col("to").alias(f"{c}_to")) for c in ("lo", "hi", "root")]
        label = written(label.join(renamed[2], "root", "left").select("vertex", F.coalesce("root_to", "root").alias("root")), "label")
        moved = rest.join(renamed[0], "lo", "left").join(renamed[1], "hi", "left").select(F.coalesce("lo_to", "lo").alias("x"), F.coalesce("hi_to", "hi").alias("y"))
        rest = written(moved.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).where("lo < hi").distinct(), "edges")
    return label
