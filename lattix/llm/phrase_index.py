"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of segments. A segment holds some whole documents: for each term the sorted
places at which it stands, documents laid end to end. A phrase is found by taking the places of
its rarest term and keeping those at which, shifted by the terms' offsets, the lists of its other
terms have an entry too, from rare to frequent. Segments are searched where they lie, without a
shuffle; test phrases go to them in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm import textscan
from lattix.llm.scratch import written

WINDOW = 10
#: Test words sent to the segments at once; a single item may be longer.
BLOCK_WORDS = 200_000
#: Bytes of text in a segment; a longer text has one of its own.
SEGMENT_BYTES = 1 << 20
#: Places compared at once.
CHUNK = 1 << 21

SEGMENT = "segment long, doc_ids array<long>, doc_first binary, terms binary, term_first binary, places binary"
FOUND = "segment long, doc_no int, item_id string, first int, last int"


def tokens(part: textscan.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Term codes of all words of a slice, and where each document's begin."""
    w = textscan.words(part, textscan.ALPHANUMERIC, lower=True)
    return w.hash, np.searchsorted(w.doc, np.arange(part.count + 1)).astype(np.int64)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of the documents, written to the shared folder. Null text has no words; every row is a document of its own."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in textscan.slices(batch.column(1), SEGMENT_BYTES):
                codes, doc_first = tokens(part)
                order = np.argsort(codes, kind="stable")
                first, length = textscan.runs(codes[order])
                ids = batch.column(0).slice(part.first, part.count)
                listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                gaps = np.diff(order.astype(np.int32), prepend=np.int32(0))
                columns = [pa.array([number]), listed, _packed(doc_first), _packed(codes[order][first]), _packed(np.r_[first, len(codes)].astype(np.int32)), _packed(gaps)]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "doc_ids", "doc_first", "terms", "term_first", "places"])
                number += 1

    return written(docs.mapInArrow(scan, SEGMENT), "index")


@dataclass
class Phrases:
    """Test phrases on end: their items, where each begins in codes, and how long it is."""

    items: list[str]
    item: np.ndarray
    first: np.ndarray
    size: np.ndarray
    codes: np.ndarray


def phrases_of(rows: list, window: int) -> Phrases:
    """All windows of consecutive words of (item_id, text) rows; an item of fewer words is one window."""
    column = pa.array([r[1] for r in rows], pa.string())
    codes, item, first, size, base = [], [], [], [], 0
    for part in textscan.slices(column):
        own, begins = tokens(part)
        for i in range(part.count):
            n = int(begins[i + 1] - begins[i])
            many = max(n - window + 1, 1) if n else 0
            first.append(base + begins[i] + np.arange(many))
            item.append(np.full(many, part.first + i))
            size.append(np.full(many, min(n, window)))
        codes.append(own)
        base += len(own)
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return Phrases([str(r[0]) for r in rows], join(item, np.int64), join(first, np.int64), join(size, np.int64), join(codes, np.uint64))


def blocks(tests: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """Rows of the test table, as many at a time as have about BLOCK_WORDS words."""
    rows, words = [], 0
    for r in tests.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        rows.append(r)
        words += len(r[1] or "") // 2
        if words > BLOCK_WORDS:
            yield rows
            rows, words = [], 0
    if rows:
        yield rows


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each code of a sorted vocabulary stands in the whole corpus."""

    def scan(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, first in zip(batch.column(0), batch.column(1), strict=True):
                terms, first = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(first.as_buffer(), np.int32)
                at = np.searchsorted(terms, vocabulary)
                there = np.flatnonzero(at < len(terms))
                there = there[terms[at[there]] == vocabulary[there]]
                total[there] += first[at[there] + 1] - first[at[there]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    counts = np.zeros(len(vocabulary), np.int64)
    rows = index.select("terms", "term_first").mapInArrow(scan, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each test term at most
    for term, n in rows:
        counts[term] = n
    return counts


class Segment:
    """One segment's lists, as keys term * length + place in ascending order."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
        self.doc_first, self.terms, self.term_first = read("doc_first", np.int64), read("terms", np.uint64), read("term_first", np.int32).astype(np.int64)
        self.places = np.cumsum(read("places", np.int32), dtype=np.int64)
        self.length = len(self.places)
        self.keys = self.places + np.repeat(np.arange(len(self.terms)), np.diff(self.term_first)) * self.length if self.length else self.places

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The terms' numbers, -1 for those that the segment hasn't."""
        at = np.searchsorted(self.terms, codes)
        out = np.full(len(codes), -1, np.int64)
        there = np.flatnonzero(at < len(self.terms))
        there = there[self.terms[at[there]] == codes[there]]
        out[there] = at[there]
        return out

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = term * self.length + place
        at = np.searchsorted(self.keys, key)
        return (place >= 0) & (place < self.length) & (self.keys[np.minimum(at, self.length - 1)] == key)

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_first, place, side="right") - 1

    def candidates(self, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position in term, place) of every entry of the terms' lists, about CHUNK at a time."""
        count = self.term_first[term + 1] - self.term_first[term]
        group = np.cumsum(count) // CHUNK
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            n = count[own]
            owner = np.repeat(own, n)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            yield owner, self.places[self.term_first[term[owner]] + within]


def by_rarity(p: Phrases, counts: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each phrase's words from the rarest to the most frequent, and the words' vocabulary numbers in that order; -1 beyond its size."""
    width = int(p.size.max())
    at = p.first[:, None] + np.arange(width)
    inside = np.arange(width) < p.size[:, None]
    vocabulary = number[np.minimum(at, len(number) - 1)]
    order = np.argsort(np.where(inside, counts[vocabulary], np.iinfo(np.int64).max), axis=1, kind="stable")
    return order, np.where(np.take_along_axis(inside, order, 1), np.take_along_axis(vocabulary, order, 1), -1)


def phrase_matches(index: DataFrame, tests: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(segment, doc_no, item_id, first, last): documents' words, both ends included, that equal windows of an item; runs that overlap are joined.

    Windows are of consecutive words; a test of fewer words than the window counts as one phrase.
    """
    found = None
    for rows in blocks(tests, id_col, text_col):
        p = phrases_of(rows, window)
        if not len(p.first):
            continue
        vocabulary, number = np.unique(p.codes, return_inverse=True)
        counts = term_counts(index, vocabulary)
        order, ranked = by_rarity(p, counts, number)
        alive = (np.where(ranked < 0, 1, counts[ranked]) > 0).all(axis=1)
        order, ranked, item, size = order[alive], ranked[alive], p.item[alive], p.size[alive]
        new = index.mapInArrow(_phrase_scan(vocabulary, order, ranked, item, size, p.items), FOUND)
        found = new if found is None else found.union(new)
    return found if found is not None else index.sparkSession.createDataFrame([], FOUND)


def _phrase_scan(vocabulary, order, ranked, item, size, names):
    def scan(batches):
        for batch in batches:
            for row in batch.to_struct_array():
                s = Segment(row)
                if not s.length or not len(size):
                    continue
                local = np.where(ranked < 0, 0, s.numbers(vocabulary)[ranked])
                here = np.flatnonzero((local >= 0).all(axis=1))
                out = []
                for owner, place in s.candidates(local[here, 0]) if len(here) else ():
                    owner = here[owner]
                    start = place - order[owner, 0]
                    for r in range(1, order.shape[1]):
                        fits = s.has(local[owner, r], start + order[owner, r]) | (ranked[owner, r] < 0)
                        owner, start = owner[fits], start[fits]
                    last = start + size[owner] - 1
                    fits = (start >= 0) & (last < s.length)
                    owner, start, last = owner[fits], start[fits], last[fits]
                    doc = s.doc_of(start)
                    fits = doc == s.doc_of(last)
                    out.append((doc[fits], item[owner[fits]], start[fits], last[fits]))
                doc, it, start, last = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
                if not len(doc):
                    continue
                by = np.lexsort((start, it, doc))
                doc, it, start, last = doc[by], it[by], start[by], last[by]
                # windows of one item overlap if the next begins before the furthest end so far; sizes within an item are equal
                new = np.r_[True, (doc[1:] != doc[:-1]) | (it[1:] != it[:-1]) | (start[1:] > last[:-1] + 1)]
                at = np.flatnonzero(new)
                ends = last[np.r_[at[1:], len(last)] - 1]
                base = s.doc_first[doc[at]]
                columns = [pa.array(np.full(len(at), row["segment"].as_py())), pa.array(doc[at].astype(np.int32)), pa.array([names[i] for i in it[at]]), pa.array((start[at] - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "doc_no", "item_id", "first", "last"])

    return scan


def proximity_matches(index: DataFrame, tests: DataFrame, id_col: str = "item_id", text_col: str = "text", terms: int = 3, within: int = 20) -> DataFrame:
    """(segment, doc_no, item_id, first, last): where an item's rarest distinct terms, in any order, stand within so many words of the rarest of them.

    first and last are the place of the rarest term, which stands for the match. Items with fewer
    distinct terms need all of them.
    """
    found = None
    for rows in blocks(tests, id_col, text_col):
        p = phrases_of(rows, 1)
        if not len(p.first):
            continue
        vocabulary, number = np.unique(p.codes, return_inverse=True)
        counts = term_counts(index, vocabulary)
        chosen = np.full((len(p.items), terms), -1, np.int64)
        for i in np.unique(p.item):
            own = np.unique(number[p.first[p.item == i]])
            own = own[np.argsort(counts[own], kind="stable")][:terms]
            chosen[i, : len(own)] = own
        new = index.mapInArrow(_near_scan(vocabulary, chosen, within, p.items), FOUND)
        found = new if found is None else found.union(new)
    return found if found is not None else index.sparkSession.createDataFrame([], FOUND)


def _near_scan(vocabulary, chosen, within, names):
    def scan(batches):
        for batch in batches:
            for row in batch.to_struct_array():
                s = Segment(row)
                if not s.length:
                    continue
                local = np.where(chosen < 0, 0, s.numbers(vocabulary)[chosen])
                here = np.flatnonzero((local >= 0).all(axis=1) & (chosen[:, 0] >= 0))
                for owner, place in s.candidates(local[here, 0]) if len(here) else ():
                    owner = here[owner]
                    doc = s.doc_of(place)
                    low, high = np.maximum(place - within, s.doc_first[doc]), np.minimum(place + within, s.doc_first[doc + 1] - 1)
                    fits = np.ones(len(owner), bool)
                    for r in range(1, chosen.shape[1]):
                        base = local[owner, r] * s.length
                        fits &= (np.searchsorted(s.keys, base + high, side="right") > np.searchsorted(s.keys, base + low)) | (chosen[owner, r] < 0)
                    owner, place, doc = owner[fits], place[fits] - s.doc_first[doc[fits]], doc[fits]
                    where = pa.array(place.astype(np.int32))
                    columns = [pa.array(np.full(len(owner), row["segment"].as_py())), pa.array(doc.astype(np.int32)), pa.array([names[i] for i in owner], pa.string()), where, where]
                    yield pa.RecordBatch.from_arrays(columns, ["segment", "doc_no", "item_id", "first", "last"])

    return scan


def documents_of(index: DataFrame) -> DataFrame:
    """(segment, doc_no, doc_id, n_words) of every document."""

    def scan(batches):
        for batch in batches:
            for segment, ids, first in zip(*batch.columns, strict=True):
                n = np.diff(np.frombuffer(first.as_buffer(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), segment.as_py())), pa.array(np.arange(len(n), dtype=np.int32)), ids.values, pa.array(n)], ["segment", "doc_no", "doc_id", "n_words"])

    return index.select("segment", "doc_ids", "doc_first").mapInArrow(scan, "segment long, doc_no int, doc_id long, n_words long")


def contamination(documents: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of ASCII letters, lower-cased, digits and everything beyond ASCII. n_hit counts the document's
    words inside any occurrence of a window of consecutive test words. Null and empty texts have no words
    and no hits; items without words have no windows; an item's null id reads None. Repeated rows stay rows.
    """
    index = build_index(documents, id_col, text_col)
    spans = phrase_matches(index, tests, item_id_col, item_text_col, window)
    grouped = spans.groupBy("segment", "doc_no").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    covered = "aggregate(spans, struct(0L as n, -1 as past), (a, s) -> struct(a.n + greatest(s.last - greatest(s.first, a.past + 1) + 1, 0) as n, greatest(a.past, s.last) as past), a -> a.n)"
    hit = grouped.select("segment", "doc_no", F.expr(covered).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    joined = documents_of(index).join(hit, ["segment", "doc_no"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
