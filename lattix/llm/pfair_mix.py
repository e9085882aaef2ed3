"""Mixing sources to target weights by Pfair scheduling.

Sources are cut into blocks of rows. With weight w, a source's block j is released at slot floor(j / w)
and due by ceil((j + 1) / w); of the released blocks the one due first takes a slot. As weights add up to 1, every block
keeps its window, so that at any slot each source is less than one block from its share. Weights are
exact: releases and deadlines are whole-number arithmetic on them, whatever their size.

The schedule is worked out in segments of slots, in parallel. At a segment's bounds a block whose window crosses the bound
is either done or not. Which ones are follows from the bound alone: as many as there are slots for, those due first
as long as all that are done fit into the slots before. Both sides of a bound then have a schedule that keeps
all windows, and both know what the other has. Segments are longer than any window.

When a source has run out, the others go on with their weights among themselves, in a new schedule from there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattix.llm.scratch import written

BLOCK_ROWS = 32
#: Slots of a segment, at least.
SEGMENT = 1 << 16
#: Rows that are numbered together.
RUN_ROWS = 4096
#: Up to so many sources' sizes are sent to every executor.
BROADCAST_SOURCES = 100_000


def whole(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers, exactly."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    common = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * common) for s, x in exact.items()}


def done_at(t: int, weights: list[int]) -> list[int]:
    """How many blocks of each source are done before slot t."""
    total = sum(weights)
    floor = [t * w // total for w in weights]
    crossing = [i for i, w in enumerate(weights) if t * w % total]
    many = t - sum(floor)
    if not many:
        return floor
    release = {i: floor[i] * total // weights[i] for i in crossing}
    start = min(release.values())
    # spare[a - start]: slots from a to t less the blocks that have to go there
    held = np.zeros(t - start + 1, np.int64)
    for w, upto in zip(weights, floor, strict=True):
        for j in range(-(-start * w // total), upto):
            held[j * total // w - start] += 1
    spare = np.arange(t - start, -1, -1) - np.cumsum(held[::-1])[::-1]
    for i in sorted(crossing, key=lambda i: (-(-(floor[i] + 1) * total // weights[i]), i)):
        reach = spare[: release[i] - start + 1]
        if reach.min() > 0:
            reach -= 1
            floor[i] += 1
            many -= 1
            if not many:
                break
    return floor


def segment(t0: int, t1: int, weights: list[int]) -> Iterator[tuple[int, int]]:
    """(source, block) of each slot from t0 to t1: earliest deadline first, among blocks that are released."""
    total, first, past = sum(weights), done_at(t0, weights), done_at(t1, weights)
    waiting = [(max(t0, first[i] * total // w), i, first[i]) for i, w in enumerate(weights) if first[i] < past[i]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for slot in range(t0, t1):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (min(t1, -(-(j + 1) * total // weights[i])), i, j))
        due, i, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block misses its window")
        yield i, j
        if j + 1 < past[i]:
            heapq.heappush(waiting, ((j + 1) * total // weights[i], i, j + 1))


def phases(weights: dict[str, int], blocks: dict[str, int]) -> Iterator[dict]:
    """Schedules one after another: their sources, weights, blocks done before, first slot, slots, and the source of a last slot of its own, if any."""
    used, at = dict.fromkeys(weights, 0), 0
    live = sorted(s for s in weights if blocks.get(s, 0) > 0)
    while live:
        own, left = [weights[s] for s in live], [blocks[s] - used[s] for s in live]
        total = sum(own)
        ends = [Fraction(n * total, w) for n, w in zip(left, own, strict=True)]
        length = int(min(ends))
        done = done_at(length, own)
        last = next((i for i, n in enumerate(done) if n < left[i] and ends[i] < length + 1), None)  # due by the very next slot, so there is one at most
        yield {"sources": live, "weights": own, "before": [used[s] for s in live], "start": at, "length": length, "last": last}
        at += length + (last is not None)
        for i, s in enumerate(live):
            used[s] += done[i] + (i == last)
        live = [s for s in live if used[s] < blocks[s]]


def schedule(spark: SparkSession, found: list[dict]) -> DataFrame:
    """(source, block, slot) of phases, written to the shared folder."""
    rows = []
    for p in found:
        step = max(SEGMENT, 3 + sum(p["weights"]) // min(p["weights"]))  # longer than the longest window
        cuts = [*range(0, max(p["length"] - step, 0) + 1, step), p["length"]]
        own = (p["sources"], [str(w) for w in p["weights"]], p["before"], p["start"])
        rows += [(*own, a, b, p["last"] if b == p["length"] else None) for a, b in zip(cuts, cuts[1:], strict=False)]

    def work(batches):
        for batch in batches:
            for r in batch.to_pylist():
                weights = [int(w) for w in r["weights"]]
                slots = list(segment(r["t0"], r["t1"], weights))
                if r["last"] is not None:
                    slots.append((r["last"], done_at(r["t1"], weights)[r["last"]]))
                of, block = (np.array(x) for x in zip(*slots, strict=True))
                slot = r["start"] + r["t0"] + np.arange(len(slots))
                yield pa.RecordBatch.from_arrays([pa.array(r["sources"]).take(pa.array(of)), pa.array(block + np.array(r["before"])[of]), pa.array(slot)], ["source", "block", "slot"])

    table = spark.createDataFrame(rows, "sources array<string>, weights array<string>, before array<long>, start long, t0 long, t1 long, last int")
    return written(table.repartition(min(len(rows), 1000), "start", "t0").mapInArrow(work, "source string, block long, slot long"), "schedule")


def runs_of(rows: DataFrame, count: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with run, and (source, run, base): how many rows of its source a run follows.

    A source is dealt by the leading bits of the hash into runs of about RUN_ROWS rows, which are numbered
    on their own and follow each other, so no source is ever sorted in one task.
    """
    dealt = rows.join(count.select("source", F.ceil(F.col("n") / RUN_ROWS).alias("runs")), "source")
    dealt = dealt.withColumn("run", F.expr("bigint(floor(shiftrightunsigned(hash, 11) / 9007199254740992D * runs))")).drop("runs")
    sizes = dealt.groupBy("source", "run").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run
    return dealt, sizes.select("source", "run", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))


def mix_sources(documents: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS, seed: int = 0, power: float = 0.5) -> DataFrame:
    """The documents, all columns, and block (its number in the source), slot (that of the block) and position (of the row), which replace columns of these names.

    weights gives each source its share; those that it doesn't name go last, in proportion to their rows. Without weights a source's
    is its number of rows to the power. Rows of a source are in the order of a seeded hash of id and row, so equal
    rows are interchangeable. Every row is kept. A null source is a source of its own. An empty table gives no rows. The driver holds a
    row for each source and plans a phase whenever one runs out.
    """
    spark = documents.sparkSession
    plain = [c for c, kind in documents.dtypes if not kind.startswith("map") and kind != "variant"]
    packed = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c not in ("block", "slot", "position")]).alias("doc")
    source = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("")).alias("source")
    rows = documents.select(source, F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string"), F.struct(*[F.col(f"`{c}`") for c in plain])).alias("hash"), packed)
    sizes = {r[0]: r[1] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}
    named = {f"={s}" if s is not None else "": w for s, w in (weights or {}).items() if w > 0}
    if weights is None:
        named = {s: float(n) ** power for s, n in sizes.items()}
    first = {s: w for s, w in named.items() if s in sizes}
    found = list(phases(whole(first), blocks)) if first else []
    done = found[-1]["start"] + found[-1]["length"] + (found[-1]["last"] is not None) if found else 0
    rest = {s: n for s, n in sizes.items() if s not in first}
    found += [p | {"start": p["start"] + done} for p in (phases(rest, blocks) if rest else [])]
    if not found:
        return rows.select("doc.*", *[F.lit(None).cast("long").alias(c) for c in ("block", "slot", "position")])
    count = spark.createDataFrame(list(sizes.items()), "source string, n long")
    dealt, runs = runs_of(rows, F.broadcast(count) if len(sizes) <= BROADCAST_SOURCES else count)
    # each run gets the slots of its blocks as one small array, so documents move once, to be numbered
    of_run = runs.withColumn("block", F.explode(F.expr(f"sequence(base div {block_rows}, (base + n - 1) div {block_rows})")))
    slots = of_run.join(schedule(spark, found), ["source", "block"]).groupBy("source", "run", "base").agg(F.expr("transform(array_sort(collect_list(struct(block, slot))), x -> x.slot)").alias("slots"))
    own = dealt.withColumn("place", F.row_number().over(Window.partitionBy("source", "run").orderBy("hash")))
    placed = own.join(slots, ["source", "run"]).withColumn("number", F.col("base") + F.col("place") - 1)
    placed = placed.withColumn("block", F.expr(f"number div {block_rows}")).withColumn("slot", F.expr(f"slots[int(block - base div {block_rows})]"))
    return placed.select("doc.*", "block", "slot", F.expr(f"slot * {block_rows} + number % {block_rows}").alias("position"))
