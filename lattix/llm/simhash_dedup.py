"""Near duplicates by SimHash: fingerprints of 64 bits, linked if few of these differ.

Equal fingerprints are one class. The bits are cut into blocks; two fingerprints that differ in at most k bits agree on all but k of
the blocks. For each choice of blocks to agree on, classes meet that share their contents, and the bits in which they differ are counted
there: candidates never leave that place, and a link leaves it at the first choice only.

Classes meet at a choice only if few share it, which counts that are combined before their shuffle tell. Those that share some choice with many go on, all of
them, to the next of SCHEMES, which has more blocks and so more bits to agree on. Two classes that were not compared therefore meet
in the next scheme. In the last one so few bits are left open that no more than 512 classes can meet, so that work grows with the number of classes
whatever their likeness.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.components import connected_components
from lattix.llm.scratch import drop_since, made, written
from lattix.llm.textscan import runs

#: Words of a shingle, and the seed of their hash.
SHINGLE, SEED = 3, 42
#: So many bits of two linked fingerprints differ at most.
BITS = 3
#: Numbers of blocks, from one scheme to the next: 20, 165 and 1540 choices, with at least 31, 46 and 55 bits to agree on for three that differ.
SCHEMES = (6, 11, 22)
#: In all but the last, classes that share a choice are compared if they are so many at most.
MANY = 128
#: Up to so many rows are sent to every executor.
BROADCAST_ROWS = 500_000
#: Bits of so many shingles are counted at once.
TOGETHER = 1 << 15

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingles(words: list[bytes], n: int) -> Iterator[bytes]:
    """Runs of n words, repeats included; the whole sequence if it is shorter."""
    return map(b" ".join, zip(*(words[k:] for k in range(n)))) if len(words) >= n else iter([b" ".join(words)] if words else [])


def fingerprints(texts: list[bytes | None], n: int = SHINGLE) -> np.ndarray:
    """A bit is set if more than half of a text's shingles have it set."""
    listed = [[_hash(s) for s in shingles((t or b"").lower().split(), n)] for t in texts]  # bytes: A-Z only, and words end at ASCII spaces
    many = np.array([len(x) for x in listed], np.int64)
    value, doc = np.fromiter(chain.from_iterable(listed), np.uint64, int(many.sum())), np.repeat(np.arange(len(texts)), many)
    counts = np.zeros((len(texts), 64), np.int64)
    for start in range(0, len(value), TOGETHER):
        bits = np.unpackbits(value[start : start + TOGETHER].view(np.uint8), bitorder="little").reshape(-1, 64)
        first, _ = runs(part := doc[start : start + TOGETHER])
        counts[part[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > many[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _scan(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        size, at = 0, 0
        for k in range(len(texts)):
            size += len(texts[k].as_py() or b"")
            if size > 8 * TOGETHER or k + 1 == len(texts):
                found = fingerprints(texts.slice(at, k + 1 - at).to_pylist(), n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, k + 1 - at), pa.array(found.view(np.int64))], ["doc_id", "fp"])
                size, at = 0, k + 1


def choices(blocks: int, bits: int) -> np.ndarray:
    """Masks of the bits to agree on, one for each choice of blocks."""
    cut = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << cut[k + 1]) - (1 << cut[k])) for k in range(blocks)]
    return np.array([sum(c) for c in combinations(block, blocks - bits)], np.uint64)


def _shared(classes: DataFrame, masks: np.ndarray) -> DataFrame:
    """(choice, agreed, fp): each class once for every choice."""
    each = classes.select("fp", F.posexplode(F.array(*map(F.lit, masks.view(np.int64).tolist()))).alias("choice", "mask"))
    return each.select("choice", F.col("fp").bitwiseAND(F.col("mask")).alias("agreed"), "fp")


def _met(shared: DataFrame, masks: np.ndarray, bits: int) -> DataFrame:
    """Links (a, b) of classes that share a choice, each at the first choice that it shares. One pass over sorted rows, which holds the last group back."""

    def linked(choice, agreed, fp):
        at = np.arange(len(fp))
        for d in range(1, len(fp)):
            at = at[at + d < len(fp)]
            at = at[(choice[at] == choice[at + d]) & (agreed[at] == agreed[at + d])]
            if not len(at):
                break
            apart = fp[at] ^ fp[at + d]
            near = np.bitwise_count(apart) <= bits
            apart, own = apart[near], at[near]
            for part in np.array_split(np.arange(len(own)), len(own) // 4096 + 1):
                first = np.argmax((apart[part][:, None] & masks[None, :]) == 0, axis=1) == choice[own[part]]
                x = own[part][first]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)), pa.array(fp[x + d].view(np.int64))], ["a", "b"])

    def scan(batches):
        held = None
        for batch in chain(batches, [None]):
            rows = held if batch is None else [c.to_numpy().view(t) for c, t in zip(batch.columns, (np.int32, np.int64, np.uint64), strict=True)]
            if batch is not None and held is not None:
                rows = [np.r_[x, y] for x, y in zip(held, rows, strict=True)]
            if rows is None or not len(rows[0]):
                continue
            choice, agreed, _ = rows
            done = len(choice)
            if batch is not None:
                done = int(np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (agreed[1:] != agreed[:-1])])[-1])
            held = [x[done:] for x in rows]
            yield from linked(*(x[:done] for x in rows))

    return shared.repartition("choice", "agreed").sortWithinPartitions("choice", "agreed").mapInArrow(scan, "a long, b long")


def _small(rows: DataFrame) -> DataFrame:
    """For a join: sent to all executors if that is few rows, else shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def linked_fingerprints(classes: DataFrame, bits: int = BITS, schemes: tuple[int, ...] = SCHEMES, many: int = MANY) -> DataFrame:
    """All links (a, b) of different fingerprints of the column fp, a written table of distinct ones; a link may come twice."""
    rest, links = classes.select("fp"), None
    for blocks in schemes:
        masks = choices(blocks, bits)
        shared = _shared(rest, masks)
        crowded = None
        if blocks != schemes[-1]:
            crowded = written(shared.groupBy("choice", "agreed").count().where(F.col("count") > many).select("choice", "agreed"), "crowded")
            crowded = None if crowded.isEmpty() else _small(crowded)
        near = shared if crowded is None else shared.join(crowded, ["choice", "agreed"], "left_anti")
        met = written(_met(near, masks, bits), "links")
        links = met if links is None else links.union(met)
        if crowded is None:
            break
        rest = written(shared.join(crowded, ["choice", "agreed"], "left_semi").select("fp").distinct(), "rest")
    return links


def near_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Per row: doc_id, fp (the fingerprint as a signed number) and component_id, the least id that links lead to.

    Words are what lies between ASCII spaces, A-Z lower-cased; shingles are runs of n, repeats included, or the whole of a shorter
    text. Null, empty and blank texts have fingerprint 0, which links as any other. Repeated rows stay rows;
    rows without an id link by text like others, and component_id is null only if all rows of a component lack one. Ids are numbers. Other columns don't matter.
    """
    spark, start = documents.sparkSession, made()
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(rows.mapInArrow(partial(_scan, n), "doc_id long, fp long"), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    label = connected_components(linked_fingerprints(classes, bits)).withColumnRenamed("vertex", "fp")
    joined = classes.join(label, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"), "named")
    drop_since(spark, start, rows, named)
    return rows.join(_small(named), "fp").select("doc_id", "fp", "component_id")
