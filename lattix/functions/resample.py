"""Percentile intervals by exact resampling with replacement, of quantiles and of any function of sums, over tables of any size.

The n draws of a resample aren't dealt out one by one: a binary tree over the ordered rows splits their number by binomials, down to chunks of CHUNK rows, and only there rows are drawn.
Each node has a generator of its own, so a task walks from the root to its rows without hearing of others, and what is drawn depends on the seed and the rows' order alone, not on how they are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.operators.shared import cut

#: Rows that are drawn from at once.
CHUNK = 4096


def walk(n: int, draws: np.ndarray, seed: int, since: int, until: int, wanted: Callable | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(chunk, drawn, before) of the chunks from one up to another, in order: how many draws of each resample fall into it, and before it. Nodes that aren't wanted, by the same two, are passed over."""
    todo = [(0, -(-n // CHUNK), draws, np.zeros_like(draws))]
    while todo:
        first, last, own, before = todo.pop()
        if first >= until or last <= since or wanted and not wanted(own, before).any():
            continue
        if last - first == 1:
            yield first, own, before
            continue
        middle = (first + last) // 2
        rows = min(last * CHUNK, n) - first * CHUNK
        left = np.random.default_rng([seed, 0, first, last]).binomial(own, (middle - first) * CHUNK / rows)
        todo += [(middle, last, own - left, before + left), (first, middle, left, before)]


def counts(n: int, chunk: int, r: int, drawn: int, seed: int) -> np.ndarray:
    """How often each row of a chunk is drawn in a resample."""
    size = min(CHUNK, n - chunk * CHUNK)
    return np.bincount(np.random.default_rng([seed, 1, chunk, r]).integers(0, size, drawn), minlength=size)


def _pieces(batches: Iterator[pd.DataFrame], starts: list[int]) -> Iterator[tuple[int, pd.DataFrame]]:
    """(number of the first row, rows) of a partition, cut where chunks end."""
    at = None
    for batch in batches:
        if len(batch) and at is None:
            at = starts[int(batch["__part"].iloc[0])]
        while len(batch):
            size = min(len(batch), CHUNK - at % CHUNK)
            yield at, batch.iloc[:size]
            at, batch = at + size, batch.iloc[size:]


def _dealt(rows: DataFrame, *order: str) -> tuple[DataFrame, list[int], int]:
    """Rows in ranges of the order, each with its part, the number of each part's first row, and of all rows: a number for each partition."""
    kept = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["count"] for r in kept.groupBy("__part").count().collect()}
    starts = [0]
    for p in range(max(sizes, default=-1) + 1):
        starts.append(starts[-1] + sizes.get(p, 0))
    return kept, starts, starts[-1]


def _interval(drawn: DataFrame, n: int, level: float) -> DataFrame:
    """One row (estimate, low, high, n) of (r, v), r -1 being the sample itself."""
    if not 0 < level < 1:
        raise ValueError("a level is between 0 and 1")
    edge, own = (1 - level) / 2, F.when(F.col("r") >= 0, F.col("v"))
    return drawn.agg(F.max(F.when(F.col("r") < 0, F.col("v"))).alias("estimate"), F.percentile(own, F.lit(edge)).alias("low"), F.percentile(own, F.lit(1 - edge)).alias("high"), F.lit(n).cast("long").alias("n"))


def bootstrap_quantile(df: DataFrame, key: str, value: str, q: float = 0.5, resamples: int = 10_000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """One row (estimate, low, high, n): the sample's quantile, by linear interpolation, and the interval of those of its resamples. Null and NaN values are left out; an empty table gives nulls and n 0.

    key orders equal values. Rows are drawn only where a resample's quantile lies, so the work goes with the rows plus the resamples, not with their product.
    """
    own = df.select(F.col(key).alias("__key"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    kept, starts, n = _dealt(own, "v", "__key")
    low, high = (int(np.floor((n - 1) * q)), int(np.ceil((n - 1) * q))) if n else (0, 0)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reached = lambda drawn, before: (before <= high) & (low < before + drawn)
        nodes, node = None, None
        for at, rows in _pieces(batches, starts):
            values, chunk, inside = rows["v"].to_numpy(), at // CHUNK, at % CHUNK
            out = [(-1, rank, float(values[rank - at])) for rank in {low, high} if at <= rank < at + len(values)]
            nodes = nodes or walk(n, np.full(resamples, n, dtype=np.int64), seed, chunk, starts[-1], reached)
            while node is None or node[0] < chunk:
                node = next(nodes, (n, None, None))
            if node[0] == chunk:
                _, drawn, before = node
                for r in np.flatnonzero(reached(drawn, before)):
                    ends = before[r] + np.cumsum(counts(n, chunk, r, drawn[r], seed))
                    for rank in {low, high}:
                        i = int(np.searchsorted(ends, rank, side="right")) - inside
                        if before[r] <= rank < ends[-1] and 0 <= i < len(values):
                            out.append((int(r), rank, float(values[i])))
            if out:
                yield pd.DataFrame(out, columns=["r", "rank", "v"])

    met = kept.select("v", "__part").mapInPandas(found, "r long, rank long, v double").groupBy("r").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"))
    return _interval(met.select("r", (F.col("a") + (F.col("b") - F.col("a")) * ((n - 1) * q - low)).alias("v")), n, level)


def bootstrap_of(df: DataFrame, key: str, sums: dict[str, Column], final: Column, resamples: int = 1000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """One row (estimate, low, high, n) of a function of sums over rows: a mean, a ratio, a variance, a correlation. final is that function, of the columns that sums names and of n.

    Rows of which a term is null or NaN are left out; an empty table gives nulls and n 0. key is unique, and orders the rows. Resamples are summed within each partition; nothing but these sums is shuffled.
    """
    names = list(sums)
    own = df.select(F.col(key).alias("__key"), *[c.cast("double").alias(f"__{x}") for x, c in sums.items()])
    for x in names:
        own = own.where(F.col(f"__{x}").isNotNull() & ~F.isnan(f"__{x}"))
    kept, starts, n = _dealt(own, "__key")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, nodes, node = np.zeros((resamples + 1, len(names))), None, None
        for at, rows in _pieces(batches, starts):
            terms, chunk, inside = rows[[f"__{x}" for x in names]].to_numpy(), at // CHUNK, at % CHUNK
            nodes = nodes or walk(n, np.full(resamples, n, dtype=np.int64), seed, chunk, starts[-1])
            while node is None or node[0] < chunk:
                node = next(nodes)
            total[0] += terms.sum(axis=0)
            for r in range(resamples):
                total[r + 1] += counts(n, chunk, r, node[1][r], seed)[inside : inside + len(terms)] @ terms
        if nodes:
            yield pd.DataFrame({"r": np.arange(-1, resamples), **{x: total[:, i] for i, x in enumerate(names)}})

    parts = kept.drop("__key").mapInPandas(summed, ", ".join(["r long", *(f"`{x}` double" for x in names)]))
    whole = parts.groupBy("r").agg(*[F.sum(x).alias(x) for x in names]).withColumn("n", F.lit(n).cast("double"))
    return _interval(whole.select("r", final.cast("double").alias("v")), n, level)
