"""Small tables with what is awkward: nulls, empty and blank texts, ties, repeated rows, a long text, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n long, segment string, score double"


def words(r, n, stock="the of and to in is it on as by stone river cloud green paper light sound water glass storm night field".split()):
    return " ".join(r.choice(stock) for _ in range(n))


def corpus(seed=1, n=40):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, words(r, r.randint(1, 120)), r.choice(["en", "de"]), r.choice(["a", "a", "a", "b", "c"])))
    base = rows[5][1]
    rows.append((100, base, "en", "a"))
    rows.append((101, base.upper(), "en", "b"))
    rows.append((102, base + " extra", "en", "b"))
    rows.append((102, base + " extra", "en", "b"))
    rows += [(103, None, None, None), (104, "", "en", "a"), (105, " \n\t ", "en", "a"), (None, words(r, 30), "en", None), (106, "one", "de", "c"), (107, "one", "de", "c"), (108, "\u0001\u0002 \U0001f600 é", "de", "b")]
    rows.append((109, words(r, 9000), "en", "a"))
    return [(*x, len(x[1]) if x[1] is not None else None, 7, 8, "x", 0.5) for x in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)
