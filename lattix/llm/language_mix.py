"""Language identification by mixture inference over character n-grams.

Each word is drawn from one of the learned languages, with a likelihood that follows from its
character n-grams. Expectation-maximisation estimates a document's language proportions; of the
sets of its k most probable languages, k = 1, 2, ..., that with the best log-likelihood less a
penalty of half the logarithm of the word count for each free proportion (BIC) is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.llm import textscan
from lattix.llm.scratch import drop, written

ORDERS = (2, 3, 4)
#: N-grams are hashed to so many cells. Beyond LANGUAGES the cells are folded together, to half as many for twice the languages, so that a model has 100 MB at most.
CELLS = 1 << 17
LANGUAGES = 200
#: With fewer cells than this n-grams tell little: over 25,000 languages, more than there are, are taken for a mistaken column.
LEAST_CELLS = 1 << 10
ROUNDS = 12
#: Added to each cell's count.
SMOOTHING = 0.5
#: Proportions that make a document's language unsure, for filters.
MIN_SHARE = 0.4
UNKNOWN = "und"

#: ASCII letters and everything beyond ASCII make words; the rest separates them.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
SYMBOL = np.where(LETTERS, textscan.ASCII_LOWER, 0x20).astype(np.uint64)


def ngram_cells(part: textscan.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice (document, first byte, past byte), and for each byte inside words its cells, one column an order.

    An n-gram belongs to the word of its last byte; what comes before the word counts as a space.
    """
    symbols, inside = SYMBOL[part.data], LETTERS[part.data]
    cut = np.zeros(len(symbols) + 1, bool)
    cut[part.offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    length = end - start
    at = np.flatnonzero(inside)
    within = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    value = symbols[at]
    columns, code = [], value
    for k in range(1, max(ORDERS)):
        before = np.where(within >= k, symbols[np.maximum(at - k, 0)], 0x20)
        code = code | (before << np.uint64(8 * k))
        if k + 1 in ORDERS:
            columns.append((textscan.mix(code + np.uint64(k << 40)) % np.uint64(CELLS)).astype(np.int32))
    doc = (np.searchsorted(part.offsets, start, side="right") - 1).astype(np.int64)
    return doc, length, at, np.stack(columns, axis=1) if columns else np.zeros((0, 0), np.int32)


@dataclass
class Model:
    languages: list[str]
    #: Cells by languages: log-probability of a cell. There are CELLS of them or a power of two less.
    weight: np.ndarray

    @property
    def slice_bytes(self) -> int:
        """Texts that are judged together, fewer of them if there are many languages."""
        return textscan.SLICE_BYTES * LANGUAGES // max(LANGUAGES, len(self.languages))


def folded(languages: int) -> int:
    """The number of cells for so many languages."""
    cells = CELLS
    while cells * languages > CELLS * LANGUAGES:
        cells //= 2
    if cells < LEAST_CELLS:
        raise ValueError(f"{languages} different languages: is this column one of languages?")
    return cells


def train(documents: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """N-gram counts of all texts by language, as smoothed log-probabilities. Null texts and languages are left out."""
    docs = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for part in textscan.slices(batch.column(1)):
                doc, length, _, cells = ngram_cells(part)
                if not len(doc):
                    continue
                names, of = np.unique(langs[part.first : part.first + part.count].astype(str), return_inverse=True)
                of = np.repeat(of[doc], length)
                for i, name in enumerate(names):
                    n = np.bincount(cells[of == i].ravel(), minlength=CELLS)
                    total[name] = total[name] + n if name in total else n
                if len(total) > 16:  # hand on what is held, so that many languages don't pile up
                    yield from _counted(total)
                    total = {}
        yield from _counted(total)

    counts = written(docs.mapInArrow(scan, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")), "counts")
    cells = folded(counts.select("lang").distinct().count())
    languages = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    weight = np.full((cells, max(len(languages), 1)), SMOOTHING, np.float32)
    place = {x: i for i, x in enumerate(languages)}
    small = counts if cells == CELLS else counts.groupBy("lang", F.col("cell").bitwiseAND(cells - 1).alias("cell")).agg(F.sum("n").alias("n"))
    table = small.toArrow()  # CELLS * LANGUAGES rows at most
    drop(counts)
    of = np.array([place[x] for x in table.column(0).unique().to_pylist()], np.int64)
    if len(table):
        coded = table.column(0).combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        of = np.array([place[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        weight[table.column(1).to_numpy(), of] += table.column(2).to_numpy()
    return Model(languages, np.log(weight / weight.sum(axis=0)).astype(np.float32))


def _counted(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, n in total.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], ["lang", "cell", "n"])


def word_likelihoods(part: textscan.Slice, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Document of each word, and its log-likelihoods by language, as the mean over orders."""
    doc, length, _, cells = ngram_cells(part)
    if not len(doc):
        return doc, np.zeros((0, len(model.languages)), np.float32)
    cells &= len(model.weight) - 1
    total = model.weight[cells[:, 0]]
    for k in range(1, cells.shape[1]):
        total += model.weight[cells[:, k]]
    first = np.cumsum(length) - length
    return doc, np.add.reduceat(total, first, axis=0) / np.float32(cells.shape[1])


def expectation_maximisation(share: np.ndarray, likely: np.ndarray, first: np.ndarray, size: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of documents whose words lie on end; a proportion that starts at 0 stays 0.

    likely: each word's likelihood by language, relative to its best.
    """
    owner = np.repeat(np.arange(len(size)), size)
    for _ in range(rounds):
        joint = share[owner] * likely
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, first, axis=0) / size[:, None]
    return share, np.add.reduceat(np.log((share[owner] * likely).sum(axis=1)), first)


def infer(doc: np.ndarray, logs: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the documents with words, and their language proportions, 0 outside the chosen set."""
    first, size = textscan.runs(doc)
    if not len(first):
        return first, np.zeros((0, logs.shape[1]))
    best = logs.max(axis=1, keepdims=True)
    likely = np.maximum(np.exp(logs - best), np.float32(1e-30))
    languages = logs.shape[1]
    even = np.full((len(first), languages), 1 / languages, np.float32)
    full, _ = expectation_maximisation(even, likely, first, size, rounds)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    only = np.add.reduceat(np.log(likely), first, axis=0)
    chosen = (rank == 0).astype(np.float32)
    score = (only * chosen).sum(axis=1)
    open_ = np.arange(len(first))
    for k in range(2, languages + 1):
        own = np.repeat(np.isin(np.arange(len(first)), open_), size)
        start = np.cumsum(size[open_]) - size[open_]
        share, fit = expectation_maximisation((rank[open_] < k) / np.float32(k), likely[own], start, size[open_], rounds)
        value = fit - (k - 1) / 2 * np.log(size[open_])
        better = value > score[open_]
        open_ = open_[better]
        chosen[open_], score[open_] = share[better], value[better]
        if not len(open_):
            break
    return doc[first], chosen


def told(part: textscan.Slice, model: Model) -> tuple[list[str], np.ndarray, list[list]]:
    """Main language, its share and all chosen shares of each text of a slice."""
    name, score = [UNKNOWN] * part.count, np.zeros(part.count)
    shares: list[list] = [[] for _ in range(part.count)]
    if model.languages:
        own, found = infer(*word_likelihoods(part, model))
        ascii_letter = np.zeros(len(part.data) + 1, np.int64)
        np.cumsum(LETTERS[part.data] & (part.data < 0x80), out=ascii_letter[1:])
        plain = ascii_letter[part.offsets[1:]] > ascii_letter[part.offsets[:-1]]
        for i, p in zip(own.tolist(), found, strict=True):
            if plain[i] or any(c.isalpha() for c in part.data[part.offsets[i] : part.offsets[i + 1]].tobytes().decode("utf-8", "replace")):
                top = int(p.argmax())
                name[i], score[i] = model.languages[top], min(1.0, float(p[top]))
                shares[i] = [(model.languages[j], float(p[j])) for j in np.flatnonzero(p)]
    return name, score, shares


def language_proportions(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, proportions (language to share, chosen languages only).

    lang_pred has the largest share, which is score. Null and empty texts and texts without a letter are und with score 0
    and no proportions, as is everything if nothing was learned. Ties go to the language first in order.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches):
        for batch in batches:
            for part in textscan.slices(batch.column(1), model.slice_bytes):
                name, score, shares = told(part, model)
                ids = batch.column(0).slice(part.first, part.count)
                yield pa.RecordBatch.from_arrays([ids, pa.array(name), pa.array(score), pa.array(shares, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "proportions"])

    return docs.mapInArrow(scan, "doc_id long, lang_pred string, score double, proportions map<string,double>")


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text, mod folds, is fold; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % folds == fold, F.lit(False))


def accepted(documents: DataFrame, model: Model, text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """The rows, all columns, whose main language has a share of at least min_share; und goes, null and empty texts with it."""
    at = documents.columns.index(text_col)

    def scan(batches):
        for batch in batches:
            keep = [False] * batch.num_rows
            for part in textscan.slices(batch.column(at), model.slice_bytes):
                name, score, _ = told(part, model)
                keep[part.first : part.first + part.count] = [n != UNKNOWN and s >= min_share for n, s in zip(name, score, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(scan, documents.schema)
