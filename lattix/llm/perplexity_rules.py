"""Quality rules: repetition and length, and perplexity bands of a modified Kneser-Ney model.

The model's units are the bytes of the UTF-8 text as they are, and its order is 5, so that five bytes are a 40-bit code
without collisions. Spark counts the n-grams of all documents by language, and works out discounts, context totals and
probabilities as tables, order by order; what it gathers grows with the corpus. For scoring, each order's codes are kept as a
sorted array with their log-probabilities beside them, looked up by binary search. Executors are sent so
many rows of the model at once; a larger model comes in parts, each for some contexts, and
the texts' sums are carried from one part to the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattix.llm import textscan
from lattix.llm.scratch import drop_since, made, written

ORDER = 5
BITS = 8
#: A task hands its counts on when it holds so many n-grams.
HELD = 2_000_000
#: Rows of the model, of some 12 bytes, that executors are sent at once.
PART_ROWS = 3_000_000
#: Contexts of two bytes and more are dealt into so many cells, by which a model is cut into parts.
CELLS = 1024
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
#: A band reaches so many quartile distances beyond the quartiles of a language's log-perplexities.
FENCE = 2.0
#: A band is never narrower than this each way about the median, so that a language of few or equal texts rejects none of them.
LEAST_HALF_WIDTH = 0.1
#: Over its square root of characters, what chance alone may move a text's mean: a band is so much wider for it.
CHANCE = 4.0

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
NOT_NEWLINE = np.ones(256, dtype=bool)
NOT_NEWLINE[0x0A] = False


def _mask(order: int) -> int:
    return (1 << BITS * order) - 1


def ngram_codes(part: textscan.Slice) -> np.ndarray:
    """For each byte, the code of the ORDER bytes that end there; zeros stand before a text."""
    symbol = part.data.astype(np.uint64)
    within = np.arange(len(symbol)) - np.repeat(part.offsets[:-1], np.diff(part.offsets))
    code = symbol.copy()
    for k in range(1, ORDER):
        before = np.zeros_like(symbol)
        before[k:] = symbol[:-k]
        before[within < k] = 0
        code |= before << np.uint64(BITS * k)
    return code


def _text_and_lang(documents: DataFrame, text_col: str, lang_col: str) -> list:
    return [F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")]


def _of_language(part: textscan.Slice, langs: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Each language of a slice with the flags of its bytes."""
    names, of = np.unique(langs[part.first : part.first + part.count].astype(str), return_inverse=True)
    of = np.repeat(of, np.diff(part.offsets))
    for i, name in enumerate(names):
        yield str(name), of == i


def count_ngrams(documents: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, code, n): how often each n-gram of the highest order stands in a language's texts."""
    docs = documents.where(F.length(text_col) > 0).select(*_text_and_lang(documents, text_col, lang_col))

    def scan(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for part in textscan.slices(batch.column(0)):
                codes = ngram_codes(part)
                for name, own in _of_language(part, langs):
                    code = np.sort(codes[own])
                    first, n = textscan.runs(code)
                    code = code[first]
                    if name in held:
                        both = np.concatenate([held[name][0], code])
                        order = np.argsort(both, kind="stable")
                        first, _ = textscan.runs(both[order])
                        code, n = both[order][first], np.add.reduceat(np.concatenate([held[name][1], n])[order], first)
                    held[name] = (code, n)
                if sum(len(code) for code, _ in held.values()) > HELD:
                    yield from _rows(held)
                    held = {}
        yield from _rows(held)

    return docs.mapInArrow(scan, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _rows(held: dict) -> Iterator[pa.RecordBatch]:
    for name, (code, n) in held.items():
        for at in range(0, len(code), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(code[part]), pa.string()), pa.array(code[part].view(np.int64)), pa.array(n[part].astype(np.int64))], ["lang", "code", "n"])


def _discounts() -> list[Column]:
    """Three discounts, for counts of 1, 2 and more, from a language's counts of counts; 0.5, 1 and 1.5 where those are too few."""
    n = [F.count_if(F.col("n") == k) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    enough = (n[0] > 0) & (n[1] > 0) & (n[2] > 0) & (n[3] > 0)
    fitted = [F.try_subtract(F.lit(float(k)), (k + 1) * y * F.try_divide(n[k], n[k - 1])) for k in (1, 2, 3)]
    return [F.when(enough & (d > 0) & (d < k), d).otherwise(0.5 * k).alias(f"d{k}") for k, d in enumerate(fitted, 1)]


def kneser_ney(counts: DataFrame) -> list[DataFrame]:
    """Tables (lang, code, p, context, gamma) of orders 1 to ORDER: interpolated modified Kneser-Ney, from the counts of the highest order.

    Lower orders count the distinct bytes that stand before an n-gram. gamma is the weight that a context leaves to the order below.
    """
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = written(tables[order + 1].groupBy("lang", F.col("code").bitwiseAND(F.lit(_mask(order))).alias("code")).agg(F.count("*").alias("n")), "lower")
    out: list[DataFrame] = []
    for order in range(1, ORDER + 1):
        own = tables[order].join(F.broadcast(tables[order].groupBy("lang").agg(*_discounts())), "lang")  # a row for each language
        own = own.withColumn("taken", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))).withColumn("context", F.shiftrightunsigned("code", BITS))
        all_ = Window.partitionBy("lang", "context")  # as many rows as there are bytes
        own = own.withColumn("total", F.sum("n").over(all_)).withColumn("gamma", F.sum("taken").over(all_) / F.col("total"))
        below = F.lit(1 / (1 << BITS))
        if out:
            lower = out[-1].select("lang", F.col("code").alias("short"), F.col("p").alias("below"))
            own, below = own.withColumn("short", F.col("code").bitwiseAND(F.lit(_mask(order - 1)))).join(lower, ["lang", "short"]), F.col("below")
        out.append(written(own.select("lang", "code", ((F.col("n") - F.col("taken")) / F.col("total") + F.col("gamma") * below).alias("p"), "context", "gamma"), "level"))
    return out


@dataclass
class Level:
    """One order: sorted codes with log-probabilities, and sorted contexts with the log-weight left to the order below."""

    codes: np.ndarray
    logs: np.ndarray
    contexts: np.ndarray
    left: np.ndarray


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


def log_probability(levels: list[Level], code: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each code's last byte after those before it."""
    if not levels:
        return np.full(len(code), -np.log(1 << BITS), np.float32)
    level = levels[-1]
    if not len(level.codes):
        return log_probability(levels[:-1], code & np.uint64(_mask(len(levels) - 1)))
    at, there = _find(level.codes, code)
    out = level.logs[at]
    rest = np.flatnonzero(~there)
    if len(rest):
        short = code[rest]
        lower = log_probability(levels[:-1], short & np.uint64(_mask(len(levels) - 1)))
        at, known = _find(level.contexts, short >> np.uint64(BITS))
        out[rest] = np.where(known, level.left[at], 0) + lower
    return out


@dataclass
class Part:
    """A model's levels by language, and of each language the cells of contexts that they are for; all, if there is one part."""

    levels: dict[str, list[Level]]
    cells: dict[str, np.ndarray]

    def score(self, lang: str, codes: np.ndarray) -> np.ndarray:
        """Log-probability at each code; 0 at those that are for another part."""
        out = np.zeros(len(codes), np.float32)
        cells = self.cells.get(lang)
        own = slice(None) if cells is None else np.flatnonzero(cells[(codes >> np.uint64(BITS)).astype(np.int64) % (1 << 16) % CELLS])
        if lang in self.levels:
            code, back = np.unique(codes[own], return_inverse=True)
            out[own] = log_probability(self.levels[lang], code)[back]
        return out


def _levels(rows: pa.Table) -> dict[str, list[Level]]:
    """From rows (lang, order, is_context, code, value)."""
    coded = rows.column("lang").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    group = coded.indices.to_numpy().astype(np.int64) * 2 * (ORDER + 1) + 2 * rows.column("order").to_numpy() + rows.column("is_context").to_numpy()
    code, value = rows.column("code").to_numpy().view(np.uint64), rows.column("value").to_numpy().astype(np.float32)
    order = np.lexsort((code, group))
    first, length = textscan.runs(group[order])
    own = {int(group[order[at]]): (code[order[at : at + n]], value[order[at : at + n]]) for at, n in zip(first, length, strict=True)}
    none = (np.zeros(0, np.uint64), np.zeros(0, np.float32))
    return {lang: [Level(*own.get(i * 2 * (ORDER + 1) + 2 * k, none), *own.get(i * 2 * (ORDER + 1) + 2 * k + 1, none)) for k in range(1, ORDER + 1)] for i, lang in enumerate(coded.dictionary.to_pylist())}


def train(documents: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The model of all texts by language: (lang, order, is_context, code, value, cell), value being the logarithm of p or gamma; cell is null in orders 1 and 2, which all parts have."""
    first = made()
    rows = None
    for order, level in enumerate(kneser_ney(written(count_ngrams(documents, text_col, lang_col), "ngrams")), 1):
        named = lambda df, context, code, value, k=order: df.select("lang", F.lit(k).alias("order"), F.lit(context).alias("is_context"), F.col(code).alias("code"), F.ln(value).cast("float").alias("value"), F.expr(f"int(shiftrightunsigned(code, {BITS}) & 65535) % {CELLS}" if not context else f"int({code} & 65535) % {CELLS}").alias("cell"))
        own = named(level, False, "code", "p").union(named(level.groupBy("lang", "context").agg(F.first("gamma").alias("gamma")), True, "context", F.greatest("gamma", F.lit(1e-9))))
        own = own.withColumn("cell", F.lit(None).cast("int")) if order < 3 else own
        rows = own if rows is None else rows.union(own)
    model = written(rows, "model")
    drop_since(documents.sparkSession, first, model)
    return model


def cuts(model: DataFrame, most: int) -> list[list[tuple[str, int]] | None]:
    """The (lang, cell) of parts of about so many rows; one None for a model that needs no cut."""
    if model.count() <= most:
        return [None]
    sizes = model.where("cell is not null").groupBy("lang", "cell").count().orderBy("lang", "cell").collect()  # CELLS rows a language at most
    groups, held = [[]], 0
    for lang, cell, n in sizes:
        if groups[-1] and held + n > most:
            groups.append([])
            held = 0
        groups[-1].append((lang, cell))
        held += n
    return groups


def load(model: DataFrame, group: list[tuple[str, int]] | None) -> Part:
    """One of the parts that cuts() names."""
    if group is None:
        return Part(_levels(model.drop("cell").toArrow()), {})
    wanted = F.broadcast(model.sparkSession.createDataFrame(group, "lang string, cell int"))
    everywhere = model.where("cell is null").join(wanted.select("lang").distinct(), "lang", "left_semi")
    own = model.join(wanted, ["lang", "cell"], "left_semi").unionByName(everywhere)
    cells = {lang: np.zeros(CELLS, bool) for lang, _ in group}
    for lang, cell in group:
        cells[lang][cell] = True
    return Part(_levels(own.drop("cell").toArrow()), cells)


def base_counts(part: textscan.Slice) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    count = lambda docs, weight=None: np.bincount(docs, weight, minlength=part.count).astype(np.int64)
    of_byte = np.repeat(np.arange(part.count), np.diff(part.offsets))
    w = textscan.words(part, textscan.NOT_SPACE, lower=False)
    out = {"n_words": count(w.doc), "word_chars": count(of_byte[textscan.NOT_SPACE[part.data] & ((part.data & 0xC0) != 0x80)]), "n_symbols": count(of_byte[SYMBOLS[part.data]])}
    lines = textscan.words(part, NOT_NEWLINE, lower=False)
    marks = np.r_[0, np.cumsum(textscan.NOT_SPACE[part.data])]
    worded = marks[lines.end] > marks[lines.start]
    doc, line = lines.doc[worded], lines.hash[worded]
    order = np.lexsort((line, doc))
    again = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out["n_dup_lines"] = count(doc[order][1:][again])
    window = textscan.window_hashes(w.hash, REPEAT_WINDOW)
    own = w.doc[: len(window)]
    whole = np.flatnonzero(own == w.doc[REPEAT_WINDOW - 1 :]) if len(window) else np.zeros(0, np.int64)
    order = whole[np.lexsort((window[whole], own[whole]))]
    same = (window[order][1:] == window[order][:-1]) & (own[order][1:] == own[order][:-1])
    twice = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
    covered = np.zeros(len(w.doc), bool)
    for k in range(REPEAT_WINDOW):
        covered[twice + k] = True
    out["n_repeat_words"] = count(w.doc[covered])
    return out


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(documents: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = PART_ROWS) -> DataFrame:
    """Per row: doc_id, lang, the base counts and log_perplexity, null for empty texts. If the model comes in parts, rows with their sums are written before each further one."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), *_text_and_lang(documents, text_col, lang_col)).withColumn("total", F.lit(0.0))
    spark, groups = documents.sparkSession, cuts(model, most)
    for turn, group in enumerate(groups):
        sent, last = spark.sparkContext.broadcast(load(model, group)), turn == len(groups) - 1  # of about most rows

        def add(batches, sent=sent, last=last):
            for batch in batches:
                langs, before = np.array(batch.column(2).to_pylist(), dtype=object), batch.column(3).to_numpy()
                for part in textscan.slices(batch.column(1)):
                    codes, logs, rows = ngram_codes(part), np.zeros(len(part.data)), slice(part.first, part.first + part.count)
                    for name, own in _of_language(part, langs):
                        logs[own] = sent.value.score(name, codes[own])
                    upto, size = np.r_[0, np.cumsum(logs)], np.diff(part.offsets)
                    total = before[rows] + upto[part.offsets[1:]] - upto[part.offsets[:-1]]
                    ids, text, lang = (c.slice(part.first, part.count) for c in batch.columns[:3])
                    if last:
                        base = base_counts(part)
                        yield pa.RecordBatch.from_arrays([ids, lang, *(pa.array(base[k]) for k in BASE), pa.array(-total / np.maximum(size, 1), mask=size == 0)], ["doc_id", "lang", *BASE, "log_perplexity"])
                    else:
                        yield pa.RecordBatch.from_arrays([ids, text, lang, pa.array(total)], ["doc_id", "text", "lang", "total"])

        if last:
            return docs.mapInArrow(add, "doc_id long, lang string, " + ", ".join(f"{k} long" for k in BASE) + ", log_perplexity double")
        docs = written(docs.mapInArrow(add, "doc_id long, text string, lang string, total double"), "summed")


def bands(scored: DataFrame, fence: float = FENCE) -> DataFrame:
    """(lang, low, high): log-perplexity bounds from the quartiles of a language's documents that pass the base rules."""
    quartiles = scored.where(~F.col("base_failed")).groupBy("lang").agg(F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10000).alias("q"))
    reach = F.lit(fence) * (F.col("q")[2] - F.col("q")[0])
    low = F.least(F.col("q")[0] - reach, F.col("q")[1] - LEAST_HALF_WIDTH)
    high = F.greatest(F.col("q")[2] + reach, F.col("q")[1] + LEAST_HALF_WIDTH)
    return quartiles.select("lang", low.alias("low"), high.alias("high"))


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fence: float = FENCE) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity, low, high.

    base_failed: fewer than 10 words, or over 20 % of them in 5-word windows that come twice or more. kept: not base_failed, and
    the perplexity lies within the language's band, widened for short texts. A null language is one of its own, und. Null and empty texts have no words, fail
    and have no perplexity. A language none of whose texts pass the base rules has no band and keeps nothing, as all of it fails.
    """
    first = made()
    model = train(documents, text_col, lang_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = written(score(documents, model, id_col, text_col, lang_col).withColumn("base_failed", failed), "scored")
    drop_since(documents.sparkSession, first, scored)
    limits = bands(scored, fence)  # a row for each language
    margin = F.lit(CHANCE) / F.sqrt(F.greatest("word_chars", F.lit(1)))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low") - margin, F.col("high") + margin), F.lit(False))
    joined = scored.join(F.broadcast(limits), "lang", "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_perplexity", "low", "high")
