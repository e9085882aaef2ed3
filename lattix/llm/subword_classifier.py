"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

Each word and each of its character n-grams, word ends included, is hashed to a learned vector. A document's vector is the
mean over all of its features. Vectors and output layer are trained by stochastic gradient descent in numpy, in
one task over a bounded sample of labelled documents; all documents are scored where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm import textscan
from lattix.llm.language_mix import held_out

ORDERS = (3, 4, 5)
BUCKETS = 1 << 16
DIMENSIONS = 8
#: Labelled documents that a classifier is fitted on, by a hash of their ids.
SAMPLE = 5000
EPOCHS = 6
RATE = 0.6
SEED = 5


def feature_cells(part: textscan.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Document number and cell of every feature of a slice's texts, in no order."""
    size = np.diff(part.offsets)
    data = np.full(len(part.data) + part.count + 1, 0x20, np.uint8)  # a blank before the first text and after each
    data[np.arange(len(part.data)) + np.repeat(np.arange(part.count), size) + 1] = part.data
    w = textscan.words(part, textscan.NOT_SPACE, lower=False)
    docs, cells = [w.doc], [(w.hash % np.uint64(BUCKETS)).astype(np.int32)]
    length = w.end - w.start
    start = w.start + w.doc + 1
    # one place for each byte of a word and one for its end
    many = length + 1
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    at, doc = np.repeat(start, many) + within, np.repeat(w.doc, many)
    symbol = np.where(textscan.NOT_SPACE[data], data, 0x20).astype(np.uint64)
    code = symbol[at]
    for k in range(1, max(ORDERS)):
        code = code | (symbol[np.maximum(at - k, 0)] << np.uint64(8 * k))
        if k + 1 in ORDERS:
            whole = within + 1 >= k
            cells.append((textscan.mix(code[whole] + np.uint64((k + 1) << 56)) % np.uint64(BUCKETS)).astype(np.int32))
            docs.append(doc[whole])
    return np.concatenate(docs), np.concatenate(cells)


def bags(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Each text's batch, row, distinct cells and their shares."""
    for batch in batches:
        for part in textscan.slices(batch.column(text_at)):
            doc, cell = feature_cells(part)
            key, n = np.unique(doc * BUCKETS + cell, return_counts=True)
            at = np.searchsorted(key, np.arange(part.count + 1) * BUCKETS)
            for i in range(part.count):
                own = slice(at[i], at[i + 1])
                yield batch, part.first + i, (key[own] % BUCKETS).astype(np.int32), (n[own] / max(1, n[own].sum())).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def descend(examples: list[tuple[int, np.ndarray, np.ndarray]], classes: int = 2, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the cells for each class, and its bias, by stochastic gradient descent on (label, cells, shares).

    The output is linear in the mean vector, so a cell's vector times the output layer is all that scoring needs.
    """
    rng = np.random.default_rng(SEED)
    vector = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((classes, DIMENSIONS), np.float32), np.zeros(classes, np.float32)
    steps, step = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            label, cells, share = examples[i]
            pace = np.float32(rate * (1 - step / steps))
            step += 1
            hidden = share @ vector[cells]
            wrong = softmax(output @ hidden + bias)
            wrong[label] -= 1
            back = wrong @ output
            output -= pace * np.outer(wrong, hidden)
            bias -= pace * np.float32(0.1) * wrong
            # shares are small, so the step is by count relative to the document's most frequent cell's
            if len(cells):
                vector[cells] -= pace * np.outer(share / share.max(), back)
    return vector @ output.T, bias


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """(weight of each cell, bias) of label 1 against label 0, from at most sample labelled documents.

    Those with the least hashes of their ids are taken. Null labels and ids are left out; of a document with both labels, 0 counts, and of texts
    with one id that with the least hash. Without labelled documents all weights are 0.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(label_id_col).isNotNull()).groupBy(F.col(label_id_col).cast("long").alias("id")).agg(F.min(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample))  # sample rows at most
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    least = F.min_by(F.struct("label", "text"), F.xxhash64("text"))
    own = docs.join(chosen, "id").groupBy("id").agg(least.alias("x")).select("id", "x.label", "x.text")

    def featured(batches):
        for batch, row, cells, share in bags(batches, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([cells.tobytes()]), pa.array([share.tobytes()])], ["id", "label", "cells", "shares"])

    def fit(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["id"])
        weight, bias = descend([(r["label"], np.frombuffer(r["cells"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([(weight[:, 1] - weight[:, 0]).tobytes()]), pa.array([float(bias[1] - bias[0])])], ["weight", "bias"])

    model = own.mapInArrow(featured, "id long, label int, cells binary, shares binary").repartition(1).mapInArrow(fit, "weight binary, bias double").first()
    return np.frombuffer(model["weight"], np.float32), model["bias"]


def score(documents: DataFrame, weight: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score, the probability of label 1. Null, empty and blank texts have no feature and get the bias's."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches):
        for batch in batches:
            for part in textscan.slices(batch.column(1)):
                doc, cell = feature_cells(part)
                n = np.bincount(doc, minlength=part.count)
                total = np.bincount(doc, weight[cell], minlength=part.count)
                z = np.clip(total / np.maximum(n, 1) + bias, -50, 50)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.count), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    return docs.mapInArrow(scan, "doc_id long, score double")


def quality_scores(documents: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 from threshold on). Labels of held-out documents are not learned from."""
    weight, bias = train(documents, labels.where(~held_out("doc_id", folds, fold)), sample=sample)
    return score(documents, weight, bias).select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
