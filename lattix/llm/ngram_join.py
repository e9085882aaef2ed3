"""Jaccard join of documents on word n-grams, by PartEnum signatures.

Sets of 64-bit shingle codes fall into bands of sizes: within a band and its neighbour, two
sets with Jaccard similarity of at least t differ in at most k elements, k following from the
band alone. The domain of codes is cut into k + 1 parts, so that two such sets agree on
all of at least one part; the contents of a part are a signature. Where k is at most 2, the parts are single
elements and every subset with up to k of them left out is enumerated.

A part that is empty in both sets is no evidence and gives no signature. A pair could be lost by that only
if each other part has a difference. With e common empty parts and at most k - s differences, all but
e - 1 - s of those other parts then have exactly one, so one of the first 2e - s parts has. A set with more than s empty parts
(s from its own size) therefore also enumerates its first 2e - s + SPARE filled parts with one element left out. The spare ones make
up for parts that only the other set has empty; that these fill all of them has a chance of under 1e-11 for
a pair exactly at the threshold, far below that of equal codes of different shingles.

A bucket of sets with one signature is compared in full if it is small. In a larger one, all are compared with the first;
what that leaves apart meets in groups: a component and all components that have a bucket in common with it and are not its
largest. Sets outside the group's component are compared with all of the group, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattix.llm import textscan
from lattix.llm.components import connected_components
from lattix.llm.scratch import drop, drop_since, made, written
from lattix.llm.textscan import mix, runs

#: Sets with few differences are enumerated element by element up to this many.
ELEMENTWISE = 2
#: Signatures shared by more sets than this are not paired off.
SMALL_BUCKET = 8
#: Sets, and codes of sets, of a block; two blocks are compared in a task.
BLOCK = 1024
BLOCK_CODES = 1 << 20
#: A code of so much less than all pairs of two blocks is counted pair by pair.
DENSE = 400
#: Parts that a set with empty parts enumerates beyond what the count of these asks for.
SPARE = 4
#: Counts of codes in so many cells bound the difference of two sets from below.
CELLS = 256
#: Up to so many document ids are sent to every executor; beyond, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: For up to so many pairs, only the sets of these are shuffled to be compared.
BROADCAST_PAIRS = 1_000_000
#: Up to so many rows of blocks are sent to every executor, to fetch their sets without a shuffle of all sets.
BROADCAST_DEALT = 400_000
#: Shingle sets that a task remembers to have signed.
SEEN = 1_000_000


class Sets(NamedTuple):
    """members: (doc_id, n_shingles, key); sets: (key, n, codes) of those that share a signature; links (a, b) of keys; large: (sig, key) of large buckets."""

    members: DataFrame
    sets: DataFrame
    links: DataFrame
    large: DataFrame
    num: int
    den: int


class Bands:
    """Sizes cut where a set could no longer be similar to the smallest of the band."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        low, first, last = 1, [], []
        while low <= largest:
            first.append(low)
            last.append(low * den // num)
            low = last[-1] + 1
        last.append(low * den // num)
        self.first, self.last = np.array(first), np.array(last)
        self.bound = self.differences(self.last, self.last)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, size, side="right") - 1

    def differences(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In so many elements can similar sets of these sizes differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)


def shingle_sets(part: textscan.Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and distinct shingle codes, by document and code."""
    w = textscan.words(part, textscan.NOT_SPACE, lower=True)
    codes, docs = textscan.window_hashes(w.hash, n), w.doc[: max(0, len(w.doc) - n + 1)]
    whole = docs == w.doc[n - 1 :] if len(docs) else np.zeros(0, bool)
    codes, docs = codes[whole], docs[whole]
    first, length = runs(w.doc)
    for size in range(1, n):  # texts too short for one window
        short = first[length == size]
        if len(short):
            at = (short[:, None] + np.arange(size)).ravel()
            codes = np.r_[codes, textscan.window_hashes(w.hash[at], size)[::size]]
            docs = np.r_[docs, w.doc[short]]
    order = np.lexsort((codes, docs))
    codes, docs = codes[order], docs[order]
    new = np.r_[True, (codes[1:] != codes[:-1]) | (docs[1:] != docs[:-1])] if len(codes) else np.zeros(0, bool)
    return docs[new], codes[new]


def set_keys(codes: np.ndarray, first: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit codes of each set."""
    return tuple(mix(np.add.reduceat(mix(codes + np.uint64(s)), first)).view(np.int64) for s in (2 * seed + 1, 2 * seed + 2))


def signatures(codes: np.ndarray, first: np.ndarray, size: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the sets and their signatures."""
    owners, found = [], []
    value = mix(codes)
    band = bands.of(size)
    for up in (0, 1):
        instance = band + up
        k = bands.bound[instance]
        salt = mix(instance.astype(np.uint64) + np.uint64(77))
        for i in np.flatnonzero((k > 0) & (k <= ELEMENTWISE)):
            own = value[first[i] : first[i] + size[i]]
            total = own.sum(dtype=np.uint64)
            less = np.r_[np.zeros(1, np.uint64), own]
            if k[i] == 2:
                x, y = np.triu_indices(size[i], 1)
                less = np.r_[less, own[x] + own[y]]
            found.append(mix((total - less) ^ salt[i]))
            owners.append(np.full(len(less), i))
        wide = k > ELEMENTWISE
        if not wide.any():
            continue
        parts = np.where(wide, k + 1, 0)
        base = np.cumsum(parts) - parts
        owner = np.repeat(np.arange(len(size)), np.where(wide, size, 0))
        inside = np.repeat(wide, size)
        own_codes, own_value = codes[inside], value[inside]
        cell = base[owner] + (own_codes % (parts[owner].astype(np.uint64))).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        at, length = runs(cell[order])
        cells = cell[order][at]
        total = np.add.reduceat(own_value[order], at)
        holder = owner[order][at]
        tag = salt[holder] + (cells - base[holder]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        found.append(mix(total ^ mix(tag)))
        owners.append(holder)
        filled = np.bincount(holder, minlength=len(size))
        empty, spare = parts - filled, k - bands.differences(size, np.minimum(size * bands.den // bands.num, bands.last[instance]))
        many = np.where(wide & (empty > spare), 2 * empty - spare + SPARE, 0)
        if many.any():
            # both the part itself and the part less each element meet in one key space of its own
            thin = np.arange(len(at)) - np.repeat(np.cumsum(filled) - filled, filled) < many[holder]
            cell_of = np.repeat(np.arange(len(at)), length)
            keep = thin[cell_of] & (length[cell_of] > 1)
            less, of = total[cell_of[keep]] - own_value[order][keep], cell_of[keep]
            found += [mix(total[thin] ^ mix(tag[thin] + np.uint64(1))), mix(less ^ mix(tag[of] + np.uint64(1)))]
            owners += [holder[thin], holder[of]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(found).view(np.int64)


def _sets_of(batches: Iterator[pa.RecordBatch], n: int):
    """ids, first, size and codes of the documents with words, slice by slice; then the rows without any."""
    for batch in batches:
        ids = batch.column(0)
        for part in textscan.slices(batch.column(1)):
            docs, codes = shingle_sets(part, n)
            first, size = runs(docs)
            yield ids.slice(part.first, part.count), docs[first], first, size, codes


def _cells(codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(size)), size)
    counts = np.bincount(owner * CELLS + (mix(codes) >> np.uint64(56)).astype(np.int64), minlength=len(size) * CELLS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(len(size), CELLS)


def _binary(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    width = values.dtype.itemsize
    at = np.r_[0, np.cumsum(size)] * width
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _members(docs: DataFrame, n: int, seed: int) -> DataFrame:
    def scan(batches):
        for ids, docs_, first, size, codes in _sets_of(batches, n):
            sizes, key, check = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            if len(first):
                sizes[docs_] = size
                key[docs_], check[docs_] = set_keys(codes, first, seed)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(key), pa.array(check)], ["doc_id", "n_shingles", "key", "check"])

    return docs.mapInArrow(scan, "doc_id long, n_shingles long, key long, check long")


def _signed(docs: DataFrame, n: int, seed: int, bands: Bands) -> DataFrame:
    def scan(batches):
        seen: set[int] = set()
        for _, _, first, size, codes in _sets_of(batches, n):
            if not len(first):
                continue
            key = set_keys(codes, first, seed)[0]
            new = np.array([not (x in seen or seen.add(x)) for x in key.tolist()])
            if len(seen) > SEEN:
                seen.clear()
            keep = np.repeat(new, size)
            sizes = size[new]
            owner, sig = signatures(codes[keep], np.cumsum(sizes) - sizes, sizes, bands)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(key[new][owner])], ["sig", "key"])

    return docs.mapInArrow(scan, "sig long, key long")


def _met(signed: DataFrame) -> DataFrame:
    """(sig, a, b, large) of the signatures with more than one set: all pairs a < b of a small bucket; of a larger one each set b, with the first as a.

    One pass over sorted rows that holds back SMALL_BUCKET rows at most.
    """

    def emitted(s, k, first, large):
        """first: each row's bucket's first set; large: whether that has many."""
        yield s[large], first[large], k[large], np.ones(int(large.sum()), bool)
        s, k = s[~large], k[~large]
        for d in range(1, SMALL_BUCKET):
            same = s[d:] == s[:-d]
            if not same.any():
                break
            yield s[d:][same], k[:-d][same], k[d:][same], np.zeros(int(same.sum()), bool)

    def scan(batches):
        none = np.zeros(0, np.int64)
        held_s, held_k = none, none  # the last bucket, while it is small
        open_sig, open_first, last = None, 0, None  # the last bucket, once it is large
        for batch in chain(batches, [None]):
            s, k = (held_s, held_k) if batch is None else (np.r_[held_s, batch.column(0).to_numpy()], np.r_[held_k, batch.column(1).to_numpy()])
            if not len(s):
                continue
            new = np.r_[(s[0], k[0]) != (open_sig, last), (s[1:] != s[:-1]) | (k[1:] != k[:-1])]
            s, k = s[new], k[new]
            if not len(s):
                continue
            at, length = runs(s)
            first, large = k[at], length > SMALL_BUCKET
            if s[0] == open_sig:
                first[0], large[0] = open_first, True
            done = len(s)
            if batch is not None and not large[-1]:
                done = at[-1]
            held_s, held_k = s[done:], k[done:]
            if batch is not None and large[-1]:
                open_sig, open_first, last = s[-1], first[-1], k[-1]
            rows = np.repeat(np.arange(len(at)), length)[:done]
            for columns in emitted(s[:done], k[:done], first[rows], large[rows]):
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "a", "b", "large"])

    return signed.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(scan, "sig long, a long, b long, large boolean")


def _most_differences(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    return (a + b) * (den - num) // (den + num)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_binary())
    _, _, what = column.buffers()
    first = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
    return np.frombuffer(what, np.uint8)[first : first + len(column) * CELLS].reshape(len(column), CELLS).astype(np.int16)


def _plausible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose cell counts don't show them to differ too much."""

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                apart = np.abs(_matrix(batch.column(4)) - _matrix(batch.column(5))).sum(axis=1)
                near = (apart <= _most_differences(na, nb, num, den)) & (den * np.minimum(na, nb) >= num * np.maximum(na, nb))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in batch.columns[:2]], ["a", "b"])

    side = {c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("cells").alias(f"cells_{c}")) for c in "ab"}
    return pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "na", "nb", "cells_a", "cells_b").mapInArrow(scan, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs, from a written table, whose sets are similar enough, by counting common codes."""
    side = {c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("codes").alias(f"codes_{c}")) for c in "ab"}
    if pairs.count() <= BROADCAST_PAIRS:
        side = {c: df.join(F.broadcast(pairs.select(c).distinct()), c, "left_semi") for c, df in side.items()}
    common = F.size(F.array_intersect("codes_a", "codes_b")).cast("long")
    return pairs.join(side["b"], "b").join(side["a"], "a").where(den * common >= num * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _labelled(keys: DataFrame, label: DataFrame) -> DataFrame:
    """keys with comp, the least set that links lead to."""
    return keys.join(label.withColumnRenamed("vertex", "key"), "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root")


def _groups(large: DataFrame, label: DataFrame) -> DataFrame:
    """(major, comp): components that have a bucket in common with another one, the largest in it and, of equals, that in most buckets. large has (sig, key)."""
    part = written(_labelled(large, label).groupBy("sig", "comp").count(), "parts").withColumn("buckets", F.count("*").over(Window.partitionBy("comp")))
    size = part.groupBy("sig").agg(F.max_by("comp", F.struct("count", "buckets", "comp")).alias("major"), F.count("*").alias("comps")).where("comps > 1").select("sig", "major")
    return part.join(size, "sig").where("comp != major").select("major", "comp").distinct()


def _blocks(rows: Column, codes: Column) -> Column:
    return F.ceil(F.greatest(rows / BLOCK, codes / BLOCK_CODES)).cast("int")


def _dealt(blocks: str, seed: int) -> Column:
    return F.expr(f"int(pmod(xxhash64(key, {seed}), {blocks}))")


def _with_sets(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of blocks with their sets."""
    dealt = written(dealt, "dealt")
    return sets.join(F.broadcast(dealt) if dealt.count() <= BROADCAST_DEALT else dealt, "key")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each code, and the codes."""
    size = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(size)), size), column.flatten().to_numpy()


def common_counts(a: pa.Array, b: pa.Array) -> np.ndarray:
    """How many codes each list of a has in common with each of b; codes within a list are distinct."""
    (owner_a, code_a), (owner_b, code_b) = _lists(a), _lists(b)
    out = np.zeros((len(a), len(b)), np.float32)
    vocabulary = np.intersect1d(code_a, code_b)
    if not len(vocabulary):
        return out

    def known(owner, code):
        at = np.minimum(np.searchsorted(vocabulary, code), len(vocabulary) - 1)
        there = vocabulary[at] == code
        owner, at = owner[there], at[there]
        order = np.argsort(at, kind="stable")
        return owner[order], at[order], np.bincount(at, minlength=len(vocabulary))

    (owner_a, word_a, many_a), (owner_b, word_b, many_b) = known(owner_a, code_a), known(owner_b, code_b)
    dense = many_a * many_b * DENSE > len(a) * len(b)
    words = np.flatnonzero(dense)
    for start in range(0, len(words), 512):
        place = np.full(len(vocabulary), -1)
        place[words[start : start + 512]] = np.arange(len(words[start : start + 512]))
        x, y = np.zeros((len(a), 512), np.float32), np.zeros((len(b), 512), np.float32)
        for to, owner, word in ((x, owner_a, word_a), (y, owner_b, word_b)):
            own = place[word] >= 0
            to[owner[own], place[word[own]]] = 1
        out += x @ y.T
    rare = np.flatnonzero(~dense[word_a])
    first_b = np.cumsum(many_b) - many_b
    for part in np.split(rare, np.flatnonzero(np.diff(np.cumsum(many_b[word_a[rare]]) >> 21)) + 1):
        many = many_b[word_a[part]]
        within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        np.add.at(out, (np.repeat(owner_a[part], many), owner_b[np.repeat(first_b[word_a[part]], many) + within]), 1)
    return out


def similar(a: pa.Table, b: pa.Table, num: int, den: int) -> np.ndarray:
    """Whether each set of a is similar enough to each of b."""
    common = common_counts(a.column("codes").chunk(0), b.column("codes").chunk(0))
    size = a.column("n").to_numpy()[:, None] + b.column("n").to_numpy()[None, :]
    return (den + num) * common.astype(np.float64) >= num * size


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of enough true entries of a matrix to join all rows and columns that true entries join."""
    turned, out = np.ascontiguousarray(linked.T), []
    done, left = np.zeros(len(linked), bool), np.ones(linked.shape[1], bool)
    for start in np.flatnonzero(linked.any(axis=1)):
        stack = [] if done[start] else [start]
        done[start] = True
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(linked[i] & left):
                left[j] = False
                out.append((i, j))
                new = np.flatnonzero(turned[j] & ~done)
                done[new] = True
                out += [(x, j) for x in new]
                stack += new.tolist()
    return tuple(np.array(out, np.int64).reshape(-1, 2).T)


def _faced(rows: DataFrame, sets: DataFrame, compare, schema: str) -> DataFrame:
    """What compare gives for every two blocks of a group: minor sets (left) and all of the group. sets has (key, n) and what compare reads.

    Minor sets are dealt into blocks, all of the group into others, and every two blocks meet in a task of
    their own, so that a task holds two blocks at most whatever the group's size.
    """
    size = rows.groupBy("major").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"), _blocks(F.count_if("minor"), F.sum(F.when(F.col("minor"), F.col("n")))).alias("minors"))
    dealt = rows.join(size, "major").drop("n")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("minor").select("major", "key", "comp", F.lit(True).alias("left"), _dealt("minors", 1).alias("lo"), every("blocks").alias("hi"))
    right = dealt.where("minors > 0").select("major", "key", "comp", F.lit(False).alias("left"), every("minors").alias("lo"), _dealt("blocks", 2).alias("hi"))
    return _with_sets(left.union(right), sets).groupBy("major", "lo", "hi").applyInArrow(compare, schema).distinct()


def _across(groups: DataFrame, members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between a group's components, enough to join all that links join. members has (key, comp).

    Counts of codes in cells tell first which sets can have a partner at all; only the codes of these are fetched and compared.
    """
    sized = members.join(sets.select("key", "n"), "key")
    others = groups.join(sized, "comp").withColumn("minor", F.lit(True))
    own = groups.select("major").distinct().join(sized.withColumnRenamed("comp", "major"), "major").select("major", F.col("major").alias("comp"), "key", "n", F.lit(False).alias("minor"))
    rows = written(others.select("major", "comp", "key", "n", "minor").union(own), "groups")

    def partnered(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        comp, n, left = (table.column(c).to_numpy() for c in ("comp", "n", "left"))
        cells, right, hit = _matrix(table.column("cells").chunk(0)), np.flatnonzero(~left), np.zeros(len(n), bool)
        for i in np.flatnonzero(left):
            j = right[(comp[right] != comp[i]) & (den * np.minimum(n[right], n[i]) >= num * np.maximum(n[right], n[i]))]
            j = j[np.abs(cells[j] - cells[i]).sum(axis=1) <= _most_differences(n[j], n[i], num, den)]
            hit[j] = True
            hit[i] |= len(j) > 0
        return table.select(["major", "key"]).filter(pa.array(hit))

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("left")
        a, b = table.filter(side).combine_chunks(), table.filter(pc.invert(side)).combine_chunks()
        i, j = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(a) and len(b):
            comp = [x.column("comp").to_numpy() for x in (a, b)]
            i, j = spanning(similar(a, b, num, den) & (comp[0][:, None] != comp[1][None, :]))
        x, y = (a.column("key").to_numpy()[i], b.column("key").to_numpy()[j]) if len(i) else (i, j)
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    hits = _faced(rows, sets.select("key", "n", "cells"), partnered, "major long, key long")
    rows = written(rows.join(hits, ["major", "key"], "left_semi"), "groups")
    return _faced(rows, sets.select("key", "n", "codes"), compare, "a long, b long")


def similar_sets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5) -> Sets:
    """Classes of equal shingle sets, and verified links between them, enough to join all classes that links join. Threshold num / den.

    Null and empty texts have an empty set, key 0 and no link.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for seed in range(3):
        members = written(_members(docs, n, seed), "members")
        classes = members.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), (F.min("check") != F.max("check")).alias("clash"))
        facts = classes.agg(F.max("n"), F.max(F.col("clash").cast("int"))).first()
        if not facts[1]:
            break
        drop(members)
    else:
        raise ValueError("keys of different shingle sets met under three seeds")
    members = members.drop("check")
    if not facts[0]:
        none = spark.createDataFrame([], "key long, n long, codes array<long>, a long, b long, sig long")
        return Sets(members, none.select("key", "n", "codes"), none.select("a", "b"), none.select("sig", "key"), num, den)
    met = written(_met(_signed(docs, n, seed, Bands(num, den, facts[0]))), "met")
    keys = met.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    chosen = written(classes.select("key", "doc_id").join(keys, "key"), "chosen")
    ids = chosen.select("doc_id")
    ids = F.broadcast(ids) if chosen.count() <= BROADCAST_IDS else ids

    def scan(batches):
        for _, _, first, size, codes in _sets_of(batches, n):
            if len(first):
                cells = _binary(_cells(codes, first, size).ravel(), first, np.full(len(size), CELLS))
                listed = pa.ListArray.from_arrays(pa.array(np.r_[first, len(codes)].astype(np.int32)), pa.array(codes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(codes, first, seed)[0]), pa.array(size), cells, listed], ["key", "n", "cells", "codes"])

    schema = "key long, n long, cells binary, codes array<long>"
    # rows without an id can't be fetched by it; only the classes that have no other rows need theirs
    unnamed = docs.where("doc_id is null").select("doc_id", "text").mapInArrow(scan, schema).join(chosen.where("doc_id is null").select("key"), "key", "left_semi").select("key", "n", "cells", "codes")
    sets = written(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(scan, schema).unionByName(unnamed), "sets")
    if sets.groupBy("key").count().where("count > 1").limit(1).count():  # rows that repeat an id or have none
        sets = written(sets.dropDuplicates(["key"]), "sets")
    near = written(_plausible(met.where("a != b").select("a", "b").distinct(), sets, num, den), "near")
    links = written(_linked(near, sets, num, den), "links")
    large = met.where("large").select("sig", F.col("b").alias("key"))
    if not large.isEmpty():
        label = connected_components(links)
        groups = written(_groups(large, label), "meets")
        links = links.union(written(_across(groups, _labelled(large.select("key").distinct(), label), sets, num, den), "links"))
        drop(groups)
    drop(chosen, near)
    return Sets(members, sets, links, large, num, den)


def link_counts(found: Sets, classes: DataFrame) -> DataFrame:
    """(key, linked): to how many rows of other classes each class of (key, comp, many) is similar; classes without any may be left out.

    All links of a component whose sets were in small buckets only are known. The sets of others are counted anew,
    every two blocks of a component in a task of their own that gives a number for each set.
    """
    open_ = written(classes.join(found.large.select("key").distinct(), "key", "left_semi").select("comp").distinct(), "open")
    many = classes.select("key", "many")
    each = found.links.select(F.col("a").alias("key"), F.col("b").alias("other")).union(found.links.select("b", "a"))
    each = each.join(classes.select("key", "comp").join(open_, "comp", "left_anti").select("key"), "key", "left_semi")
    known = each.join(many.withColumnsRenamed({"key": "other"}), "other").select("key", F.col("many").alias("linked"))
    rows = classes.join(open_, "comp", "left_semi").join(found.sets.select("key", "n"), "key")
    size = rows.groupBy("comp").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    dealt = rows.join(size, "comp").withColumn("own", _dealt("blocks", 1)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("comp", "key", "many", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    num, den = found.num, found.den

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        first = pc.equal(table.column("own"), table.column("lo"))
        within = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        a, b = table.filter(first).combine_chunks(), (table if within else table.filter(pc.invert(first))).combine_chunks()
        if not len(a) or not len(b):
            return pa.table({"key": pa.array([], pa.int64()), "linked": pa.array([], pa.int64())})
        linked = similar(a, b, num, den)
        if within:
            np.fill_diagonal(linked, False)
            sides = [(a, linked @ b.column("many").to_numpy())]
        else:
            sides = [(a, linked @ b.column("many").to_numpy()), (b, linked.T @ a.column("many").to_numpy())]
        return pa.table({"key": np.concatenate([x.column("key").to_numpy() for x, _ in sides]), "linked": np.concatenate([n for _, n in sides])})

    counted = _with_sets(dealt, found.sets.select("key", "n", "codes")).groupBy("comp", "lo", "hi").applyInArrow(count, "key long, linked long")
    return known.union(counted).groupBy("key").agg(F.sum("linked").alias("linked"))


def similar_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5, count_links: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, the smallest id that links lead to; if count_links, also n_links, the number of other rows it is similar to.

    Words are what lies between ASCII spaces, A-Z lower-cased; a set has the distinct runs of n words, or the whole
    of a shorter text. Equal sets are one class, compared once. Null, empty and blank texts have 0 shingles and
    are alone. Repeated rows stay rows; rows without an id link by text like others. Ids are numbers. Other columns don't matter.
    """
    spark, first = documents.sparkSession, made()
    found = similar_sets(documents, id_col, text_col, n, num, den)
    own = found.members.where("n_shingles > 0")
    classes = _labelled(own.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")), connected_components(found.links))
    lowest = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = classes.join(lowest, "comp")
    zero, extra = F.lit(0).cast("long").alias("n_links"), []
    if count_links:
        classes = written(classes.select("key", "comp", "many"), "classes")
        named = named.join(link_counts(found, classes), "key", "left").withColumn("n_links", F.col("many") - 1 + F.coalesce("linked", F.lit(0)))
        extra = ["n_links"]
    named = written(named.select("key", "component_id", *extra), "named")
    drop_since(spark, first, found.members, named)
    linked = own.join(named, "key").select("doc_id", "n_shingles", "component_id", *extra)
    return linked.union(found.members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *([zero] if count_links else [])))
