"""Periodic runs of words within each text: stretches that repeat one block at least POWER times on end.

Runs come from Lyndon words: under one of the two orders of words, whatever follows a run is less than what its
period asks for there, and then the longest Lyndon word at some place in its first period is one period long. Those words are kept on a
stack that is built from the last word of a text to its first, once under each order. Two suffixes are compared, and a
run is stretched to both sides, by their longest common extension: some words directly, then prefix hashes by
galloping and binary search. What hashes call equal is compared word by word, each stretch once for a distance; if it isn't, the text is done anew with
another base. Every result is therefore exact.

Only words that can be in a run are put on the stack. WINDOW words in a row that lie in a run occur in it twice, whatever
its period, so a run lies within consecutive windows that their text has more than once. That is found for many texts at once by sorting hashes of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm import textscan

#: A run has so many words at least, and so many of its periods.
LENGTH, POWER = 6, 4
#: With that, windows of so many words that lie in a run occur in it again.
WINDOW = 5
#: Suffixes are compared directly for so many words, then by hashes.
DIRECT = 8
#: Of the prefix hashes; the base is drawn from a seed.
PRIME = (1 << 61) - 1
#: Texts are taken together up to so many words.
TOGETHER = 1 << 17

Run = tuple[int, int, int]


class HashMet(Exception):
    """Different words had equal hashes."""


class Extensions:
    """Longest common extensions of places of one sequence."""

    def __init__(self, codes: list[int], seed: int):
        base = 1 + int(textscan.numbered(1, seed)[0]) % (PRIME - 1)
        self.codes, self.n = codes, len(codes)
        self.prefix = list(accumulate(codes, lambda h, x: (h * base + x + 1) % PRIME, initial=0))
        self.power = list(accumulate(repeat(base, self.n), lambda h, x: h * x % PRIME, initial=1))
        self.known: dict[int, tuple[int, int]] = {}

    def _equal(self, i: int, j: int, size: int) -> bool:
        h = self.prefix
        return (h[i + size] - h[j + size] - (h[i] - h[j]) * self.power[size]) % PRIME == 0

    def _longest(self, most: int, equal) -> int:
        """The greatest size up to most that is equal, if all smaller ones are; DIRECT of them are known to be."""
        low, step = DIRECT, DIRECT
        while low + step <= most and equal(low + step):
            low, step = low + step, 2 * step
        high = min(low + step, most + 1)  # isn't equal
        while low + 1 < high:
            middle = (low + high) // 2
            low, high = (middle, high) if equal(middle) else (low, middle)
        return low

    def _verify(self, i: int, size: int, distance: int) -> None:
        """Compares the words from i on with those at the distance, but for a stretch that has been compared."""
        end = i + size
        a, b = self.known.get(distance, (i, i))
        if end < a or b < i:
            a, b = i, i
        for x, y in ((i, a), (b, end)):
            if x < y and self.codes[x:y] != self.codes[x + distance : y + distance]:
                raise HashMet
        self.known[distance] = min(a, i), max(b, end)

    def ahead(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, i < j."""
        codes, most = self.codes, self.n - j
        for k in range(min(DIRECT, most)):
            if codes[i + k] != codes[j + k]:
                return k
        if most <= DIRECT:
            return most
        d = j - i
        a, b = self.known.get(d, (0, 0))
        if i < b and a <= i + DIRECT and (b + d == self.n or codes[b] != codes[b + d]):  # compared before, up to where it ends
            self.known[d] = min(a, i), b
            return b - i
        size = self._longest(most, lambda k: self._equal(i, j, k))
        self._verify(i, size, j - i)
        return size

    def behind(self, i: int, j: int) -> int:
        """How many words before i equal those before j, i < j."""
        codes = self.codes
        for k in range(min(DIRECT, i)):
            if codes[i - 1 - k] != codes[j - 1 - k]:
                return k
        if i <= DIRECT:
            return i
        size = self._longest(i, lambda k: self._equal(i - k, j - k, k))
        self._verify(i - size, size, j - i)
        return size


def _runs(codes: list[int], seed: int) -> set[Run]:
    near, n, found = Extensions(codes, seed), len(codes), set()
    for turned in (False, True):
        stack = [n]  # where the Lyndon words begin that follow each other from the current place on, nearest on top
        last: dict[int, tuple[int, int]] = {}
        for i in range(n - 1, -1, -1):
            common = 0
            while (j := stack[-1]) < n:
                common = near.ahead(i, j)
                if j + common == n or (codes[i + common] > codes[j + common]) != turned:
                    break  # the text from j on comes first, so the Lyndon word ends here
                stack.pop()
            stack.append(i)
            period = j - i
            if j == n or common < 2 * period:
                continue  # the first Lyndon word of a run has more than two periods of it behind itself
            start, end = last.get(period, (n, n))
            if start <= i and end == j + common:
                continue
            start, end = i - near.behind(i, j), j + common
            last[period] = start, end
            if end - start >= max(LENGTH, POWER * period):
                found.add((start, end - start, period))
    return found


def runs_of(codes: list[int]) -> list[Run]:
    """(start, length, period) of all runs of a sequence, by start and period."""
    for seed in range(100):
        try:
            return sorted(_runs(codes, seed), key=lambda r: (r[0], r[2]))
        except HashMet:
            continue
    raise ArithmeticError("hashes of different words met under a hundred bases")


def stretches(texts: list[list[bytes]]) -> Iterator[tuple[int, int, int]]:
    """(number of the text, start, end) of consecutive windows that their text has more than once."""
    size = np.array([len(words) for words in texts], np.int64)
    value = np.fromiter((hash(w) for words in texts for w in words), np.int64, int(size.sum())).view(np.uint64)
    doc = np.repeat(np.arange(len(texts)), size)
    if len(doc) < WINDOW:
        return
    window = textscan.window_hashes(value, WINDOW) ^ textscan.mix(doc[WINDOW - 1 :].astype(np.uint64))
    inside = doc[WINDOW - 1 :] == doc[: len(doc) - WINDOW + 1]
    order = np.sort(window[inside])
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return
    at = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
    again = np.flatnonzero(inside & (twice[at] == window))
    first = np.flatnonzero(np.r_[True, (np.diff(again) > 1) | (np.diff(doc[again]) > 0)])
    base = np.cumsum(size) - size
    for x, y in zip(again[first], again[np.r_[first[1:] - 1, len(again) - 1]] + WINDOW, strict=True):
        if y - x >= LENGTH:
            yield int(doc[x]), int(x - base[doc[x]]), int(y - base[doc[x]])


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    dropped = bytearray(len(words))
    for start, length, period in runs:
        dropped[start + period : start + length] = b"\x01" * (length - period)
    return [w for w, gone in zip(words, dropped, strict=True) if not gone]


def _together(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """The words of the texts, in parts of about TOGETHER words. bytes.split() cuts at space and \\t \\n \\v \\f \\r, as words ask for."""
    part, held = [], 0
    for text in column.cast(pa.large_binary()):
        part.append((text.as_py() or b"").split())
        held += len(part[-1])
        if held >= TOGETHER:
            yield part
            part, held = [], 0
    if part:
        yield part


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for texts in _together(batch.column(batch.num_columns - 1)):
            runs: list[list[Run]] = [[] for _ in texts]
            for number, start, end in stretches(texts):
                codes: dict[bytes, int] = {}
                runs[number] += [(start + s, length, period) for s, length, period in runs_of([codes.setdefault(w, len(codes)) for w in texts[number][start:end]])]
            flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
            listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(own) for own in runs])].astype(np.int32)), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))
            left = pa.array([b" ".join(collapsed(words, own) if own else words) for words, own in zip(texts, runs, strict=True)], pa.binary())
            ids = [c.slice(done, len(texts)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*ids, pa.array([len(words) for words in texts], pa.int64()), listed, left.cast(pa.string())], [*batch.schema.names[:-1], "n_words", "runs", "collapsed"])
            done += len(texts)


def find_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, n_words, runs (start, length, period, by start and period) and collapsed, the text without the words after the first period of a run.

    Words are what lies between ASCII spaces; they differ if their bytes do. A run is a stretch with smallest period q
    (words q apart are equal) of at least 4 q and 6 words that can't be made longer. Runs with different
    periods may overlap. Null, empty and blank texts have no words, no runs and an empty collapsed text. Repeated rows stay rows, ids may be null and of any
    type, other columns don't matter. Each row is worked on by itself: no shuffle, and a task holds one batch of texts.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("doc_id", id_col)
