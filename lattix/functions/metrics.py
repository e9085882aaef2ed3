"""Retrieval and statistics metrics over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattix.operators.shared import cut


def ranking(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(qid, precision, recall, ndcg, rr, ap) at k. ranked has (qid, rank from 1, id), gold (qid, id); queries without gold are left out."""
    need = gold.distinct().groupBy("qid").agg(F.count("*").alias("n_gold"))
    hit = ranked.where(F.col("rank") <= k).join(gold.distinct(), ["qid", "id"]).select("qid", "rank")
    order = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    hit = hit.withColumn("nth", order)
    got = hit.groupBy("qid").agg(F.count("*").alias("n_hit"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"), F.sum(F.col("nth") / F.col("rank")).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return need.join(got, "qid", "left").select("qid", zero(F.col("n_hit") / k).alias("precision"), zero(F.col("n_hit") / F.col("n_gold")).alias("recall"), zero(F.col("dcg") / ideal).alias("ndcg"), zero(1 / F.col("first")).alias("rr"), zero(F.col("gain") / F.col("n_gold")).alias("ap"))


def confusion(df: DataFrame, said: Column, true: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1; null where nothing is divided."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    n = df.agg(count(said & true)("tp"), count(said & ~true)("fp"), count(~said & true)("fn"), count(~said & ~true)("tn"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 4)
    return n.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def holm(df: DataFrame, p: str, within: list[str]) -> DataFrame:
    """Adds adjusted: Holm's step-down correction of p among the rows of a group."""
    order = Window.partitionBy(*within).orderBy(p, *[c for c in df.columns if c != p])
    all_ = Window.partitionBy(*within)
    stepped = df.withColumn("__s", (F.count("*").over(all_) - F.row_number().over(order) + 1) * F.col(p))
    return stepped.withColumn("adjusted", F.least(F.lit(1.0), F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__s")


def cliffs_delta(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row, delta: how much more often a value of a is above one of b than below, from the ranks of distinct values and without pairing rows."""
    both = a.select(F.col(value).alias("v"), F.lit(1).alias("in_a")).union(b.select(F.col(value).alias("v"), F.lit(0).alias("in_a"))).where("v is not null")
    counts = both.groupBy("v").agg(F.sum("in_a").cast("double").alias("na"), F.sum(1 - F.col("in_a")).cast("double").alias("nb"))
    ordered = cut(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))  # ranges of values follow each other
    sizes = ordered.groupBy("part").agg(F.sum("nb").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0.0)).alias("base"))
    before = F.coalesce(F.sum("nb").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = ordered.withColumn("before", before).join(F.broadcast(base), "part").withColumn("below", F.col("base") + F.col("before"))
    total = ranked.agg(F.sum(F.col("na") * (2 * F.col("below") + F.col("nb"))).alias("sum"), F.sum("na").alias("a"), F.sum("nb").alias("b"))
    return total.select(F.round(F.try_divide(F.col("sum") - F.col("a") * F.col("b"), F.col("a") * F.col("b")), 4).alias("delta"))


def permutation_exact(pairs: DataFrame, difference: str, most: int = 16) -> DataFrame:
    """One row, p: the share of the sign changes of paired differences whose mean is at least as far from 0; all of them, for at most 16 pairs."""
    values = pairs.select(F.col(difference).cast("double").alias("d")).where("d is not null").orderBy("d").limit(most + 1)
    row = values.agg(F.sort_array(F.collect_list("d")).alias("d"))
    signs = row.where(F.size("d") <= most).select("d", F.explode(F.expr("sequence(0, shiftleft(1, size(d)) - 1)")).alias("bits"))
    total = F.expr("aggregate(transform(d, (x, i) -> if(shiftright(bits, i) % 2 = 1, -x, x)), 0D, (a, x) -> a + x)")
    own = F.expr("aggregate(d, 0D, (a, x) -> a + x)")
    return signs.agg(F.round(F.avg((F.abs(total) >= F.abs(own) - 1e-12).cast("double")), 4).alias("p"))


def permutation_sampled(pairs: DataFrame, key: str, difference: str, resamples: int = 10_000, seed: int = 1) -> DataFrame:
    """One row, p, for more pairs than permutation_exact() takes: the share of seeded sign changes, the observed one counted, whose sum is at least as far from 0. Each pair's sign in each resample is a hash of its key."""
    values = pairs.select(F.col(key).alias("k"), F.col(difference).cast("double").alias("d")).where("d is not null")
    drawn = values.select("d", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(resamples)), lambda r: F.when(F.pmod(F.xxhash64(F.col("k"), r, F.lit(seed)), F.lit(2)) == 0, 1).otherwise(-1))).alias("r", "sign"))
    sums = drawn.groupBy("r").agg(F.abs(F.sum(F.col("d") * F.col("sign"))).alias("s"))
    own = values.agg(F.abs(F.sum("d")).alias("own"), F.count("*").alias("n"), F.max(F.abs("d")).alias("most"))
    least = F.col("own") - F.col("n") * F.col("n") * 2.220446049250313e-16 * F.col("most")
    return sums.crossJoin(F.broadcast(own)).agg(F.round((F.count_if(F.col("s") >= least) + 1) / (F.count("*") + 1), 4).alias("p"))  # own is one row


def tally(df: DataFrame, by: str, passed: Column) -> DataFrame:
    """(by, passed, failed, skipped): skipped where nothing says whether it passed."""
    return df.groupBy(by).agg(F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"), F.count_if(passed.isNull()).alias("skipped"))


def bootstrap(df: DataFrame, key: str, value: str, resamples: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """One row (low, high): Poisson bootstrap interval of the mean; each row weighs in each resample as a seeded hash of its key says, so it is one pass and one small shuffle, and the same however the rows are dealt out."""
    rows = df.select(F.col(value).cast("double").alias("v"), F.col(key).alias("i")).where("v is not null")
    draws = rows.select("v", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(resamples)), lambda r: F.pmod(F.xxhash64(F.col("i"), r, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))).alias("r", "u"))
    weight = F.expr("aggregate(sequence(1, 8), named_struct('n', 0, 'p', 0.36787944117144233D, 'c', 0.36787944117144233D), (a, k) -> named_struct('n', if(u > a.c, k, a.n), 'p', a.p / k, 'c', a.c + a.p / k), a -> a.n)")
    means = draws.withColumn("w", weight).groupBy("r").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
    edge = (1 - level) / 2
    return means.agg(F.percentile("m", F.lit(edge)).alias("low"), F.percentile("m", F.lit(1 - edge)).alias("high"))
