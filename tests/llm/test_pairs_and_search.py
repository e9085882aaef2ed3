import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lattix.llm import components, line_dedup, ngram_join, phrase_index
from tests.llm.cases import corpus, frame, words


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, links=False):
    sets = [shingles(r[1]) for r in rows]
    at, many = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
                many[i] += 1
                many[j] += 1
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    low = {k: min([x for x in v if x is not None], default=None) for k, v in least.items()}
    return Counter((r[0], len(s), low[root(i)] if s else r[0], *[many[i]] * links) for i, (r, s) in enumerate(zip(rows, sets)))


def test_components_against_brute_force(spark):
    rows = corpus()
    got = ngram_join.similar_components(frame(spark), count_links=True).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows, True)
    none = ngram_join.similar_components(frame(spark, []), count_links=True)
    assert none.count() == 0 and none.columns == ["doc_id", "n_shingles", "component_id", "n_links"]


def test_near_copies_in_oversize_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_CODES", 300)
    r = random.Random(3)
    base = words(r, 60).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"w{r.randrange(1000)}"
        rows.append((i, " ".join(w), "en", "a", 0, 1, 1, "x", 0.0))
    rows += [(500 + i, rows[i % 7][1], *rows[0][2:]) for i in range(9)]
    got = ngram_join.similar_components(frame(spark, rows), count_links=True).collect()
    assert Counter(tuple(x) for x in got) == brute_components(rows, True)
    assert Counter(tuple(x) for x in ngram_join.similar_components(frame(spark, rows)).collect()) == brute_components(rows)


def test_met_pairs_of_small_and_large_buckets(spark):
    r = random.Random(5)
    rows = [(s, k) for s, many in enumerate([1, 2, 8, 9, 40, 1, 3, 700, 5]) for k in r.sample(range(5000), many) for _ in range(r.choice([1, 1, 2]))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ngram_join._met(spark.createDataFrame(rows, "sig long, key long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = defaultdict(set)
    for s, k in rows:
        own[s].add(k)
    want = Counter()
    for s, keys in own.items():
        large = len(keys) > ngram_join.SMALL_BUCKET
        want.update((s, a, b, large) for b in keys for a in keys if (a == min(keys) if large else a < b))
    assert Counter(tuple(x) for x in got) == want


def test_common_counts_against_sets():
    r = random.Random(6)
    hot = [r.randrange(10**9) for _ in range(30)]
    sets = [sorted({*r.sample(hot, r.randint(0, 30)), *(r.randrange(200) for _ in range(r.randint(0, 40)))}) for _ in range(70)]
    a, b = pa.array(sets[:40], pa.list_(pa.int64())), pa.array(sets[25:], pa.list_(pa.int64()))
    assert ngram_join.common_counts(a, b).tolist() == [[len({*x} & {*y}) for y in sets[25:]] for x in sets[:40]]


def test_pairs_at_the_threshold(spark):
    rows = []
    for n, size in enumerate([1, 2, 6, 12, 40, 90, 300]):
        for i in range(4):
            a = [f"a{size}x{i}x{j}" for j in range(size + 4)]
            cut = max(1, (size + 4) - (size + 4) // (12 if i % 2 else 30))
            rows += [(100 * n + 10 * i + k, " ".join(a[:m]), "en", "a", 0, 1, 1, "x", 0.0) for k, m in enumerate((len(a), cut))]
    got = ngram_join.similar_components(frame(spark, rows)).collect()
    assert Counter(tuple(x)[:3] for x in got) == brute_components(rows)


def test_similar_sets_share_a_signature():
    """Pairs exactly at the threshold, of sizes with many empty parts, in numbers that chance losses would show in."""
    rng, lost, tried = np.random.default_rng(8), 0, 0
    bands = ngram_join.Bands(4, 5, 2000)
    for size in (9, 18, 45, 90, 180):
        a, b, kept = [], [], size * 8 // 9
        for _ in range(400):
            both = rng.integers(0, 1 << 63, kept, dtype=np.uint64)
            a.append(np.sort(np.r_[both, rng.integers(0, 1 << 63, size - kept, dtype=np.uint64)]))
            b.append(np.sort(np.r_[both, rng.integers(0, 1 << 63, size - kept, dtype=np.uint64)]))
        assert 5 * kept >= 4 * (2 * size - kept)
        found = []
        for sets in (a, b):
            sizes = np.array([len(x) for x in sets])
            owner, sig = ngram_join.signatures(np.concatenate(sets), np.cumsum(sizes) - sizes, sizes, bands)
            found.append({(int(o), int(x)) for o, x in zip(owner, sig)})
        shared = {o for o, _ in found[0] & found[1]}
        tried += 400
        lost += 400 - len(shared)
    assert tried == 2000 and lost == 0


def test_connected_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (None, 1), (5, 4), (7, 5), (8, 2)], "a long, b long")
    assert {(r.vertex, r.root) for r in components.connected_components(edges).collect()} == {(3, 3), (4, 3), (5, 3), (7, 3), (2, 2), (8, 2), (9, 2)}
    assert components.connected_components(edges.where("false")).count() == 0


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_contamination(rows, items):
    wins = defaultdict(set)
    for item, text in items:
        w = tokens(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[i : i + 10])].add(str(item))
    out = Counter()
    for r in rows:
        w, hit, found = tokens(r[1]), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[x]
        out[r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


def items_of(rows):
    t = rows[3][1].split()
    return [(1, " ".join(t[:14]).upper()), (2, " ".join(t[4:30])), (10, "one"), (11, None), (12, ""), (13, "zebra crossing"), (14, " ".join(rows[8][1].split()[:10])), (15, "the of")]


@pytest.mark.parametrize("block", [200_000, 5])
def test_contamination_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(phrase_index, "BLOCK_WORDS", block)
    rows = corpus(seed=2)
    items = items_of(rows)
    got = phrase_index.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(tuple(r)[:6] for r in got.collect()) == brute_contamination(rows, items)


def test_phrases_do_not_cross_documents_and_proximity(spark):
    rows = [(1, "alpha beta", *[None] * 7), (2, "gamma delta alpha x x x gamma", *[None] * 7)]
    index = phrase_index.build_index(frame(spark, rows).coalesce(1))
    items = spark.createDataFrame([(1, "beta gamma"), (2, "gamma alpha"), (3, "delta alpha")], "item_id long, text string")
    assert {(r.item_id, r.first, r.last) for r in phrase_index.phrase_matches(index, items).collect()} == {("3", 1, 2)}
    near = {(r.item_id, r.first) for r in phrase_index.proximity_matches(index, items, terms=2, within=2).collect()}
    assert near in ({("2", 0), ("3", 1)}, {("2", 2), ("3", 1)})


def test_contamination_of_empty_tables(spark):
    none, items = frame(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert phrase_index.contamination(none, items).count() == 0
    got = phrase_index.contamination(frame(spark), items.where("false"))
    assert got.where("contaminated").count() == 0 and got.count() == len(corpus())


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])


def test_line_dedup_against_brute_force(spark):
    r = random.Random(4)
    lines = [words(r, r.randint(4, 9)) for _ in range(25)]
    lines += [x[:k] + "Z" + x[k + 1 :] for x in lines[:8] for k in (0, len(x) // 2, len(x) - 1)] + [x[:5] + x[6:] for x in lines[8:12]] + [x + "!" for x in lines[12:16]] + ["short", "shirt", "shorts", "four", "fore", "12345", "1234", "123456", "-----", "------", " " * 6, "", "😀" + lines[0], lines[1][1:]]
    r.shuffle(lines)
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 6))), "en", "a", 0, 1, 1, "x", 0.0) for i in range(60)]
    rows += [(70, None, *rows[0][2:]), (71, "", *rows[0][2:])]
    seen, want = [], {}
    for doc, text, *_ in rows:
        if text is None:
            want[doc] = (None, 0)
            continue
        kept, gone = [], 0
        for line in text.split("\n"):
            long, word = len(line) >= line_dedup.MIN_CHARS, re.search(r"[^\x20\x09-\x0D]", line)
            repeat = (long and any(within_one(line, x) for x in seen if len(x) >= line_dedup.MIN_CHARS)) or (bool(word) and line in seen)
            seen.append(line)
            kept += [] if repeat else [line]
            gone += repeat
        want[doc] = ("\n".join(kept), gone)
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert {x.doc_id: (x.text, x.n_removed) for x in got.collect()} == want
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_lines_that_only_repeat_exactly_are_not_joined_in_pieces(spark, monkeypatch):
    """Only what meets another line goes on to the pieces, once each; a line's own repeats are no such meeting."""
    sizes = {}
    write = line_dedup.written

    def counted(df, name):
        out = write(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    lines = [hashlib.sha256(bytes([k])).hexdigest() for k in range(30)]
    rows = [(i, "\n".join([*lines, *x]), "en", "a", 0, 1, 1, "x", 0.0) for i, x in enumerate([[], [], ["!" + lines[3]]])]
    for at_most in (line_dedup.BROADCAST_LINES, 0):  # sent to the executors or joined by a shuffle
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", at_most)
        sizes.clear()
        got = {x.doc_id: (x.text, x.n_removed) for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
        assert got == {0: (rows[0][1], 0), 1: ("", 30), 2: ("", 31)}
        assert sizes["met"] == [2] and sizes["met_lines"] == [2]


def test_short_lines_repeated_exactly_go(spark):
    rows = [(i, text, "en", "a", 0, 1, 1, "x", 0.0) for i, text in enumerate(["Home\n\nNext", "Home\n\nText\n ", "Home \nNext\n "])]
    docs = frame(spark, rows)
    got = line_dedup.dedup_lines(docs).collect()
    assert {x.doc_id: (x.text, x.n_removed) for x in got} == {0: ("Home\n\nNext", 0), 1: ("\nText\n ", 1), 2: ("Home \n ", 1)}
    staged = corpus_pipeline.dedup_lines(spark, docs.select(*corpus_pipeline.COLUMNS), "").collect()
    assert {x.doc_id: x.text for x in staged} == {x.doc_id: x.text for x in got}


def test_line_dedup_of_repeated_rows_many_lines_and_clashing_names(spark):
    line = "a line that stands here again and again"
    rows = [(1, "x one\n" + line), (1, "x one\n" + line), (2, "\n".join([line] * 20_000 + ["end"])), (None, None), (3, "")]
    df = spark.createDataFrame([(i, t, 5, 6, 7) for i, t in rows], "doc_id long, text string, n_lines int, n_removed int, `a.b` int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "a.b", "n_lines", "n_removed"]
    assert Counter((x.doc_id, x.text, x.n_lines, x.n_removed) for x in got.collect()) == Counter([(1, rows[0][1], 2, 0), (1, "", 2, 2), (2, "end", 20_001, 20_000), (None, None, 0, 0), (3, "", 1, 0)])


def test_line_dedup_without_ids_and_with_one_id(spark):
    """Repeats go wherever they stand: of rows without an id, of rows with one id and other texts, of rows that repeat id and text."""
    a, b = "a line that is long enough to be here", "a line that is long enough to be hers"
    docs = [(None, a), (None, a), (None, b), (7, "under\nseven " + a), (7, "under\nseven " + b), (8, "once"), (8, "once"), (8, "once"), (9, "only here\n\n"), (9, "only here\n\n"), (None, None), (None, None), (None, ""), (None, "")]
    got = line_dedup.dedup_lines(spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, k long").repartition(3)).collect()
    assert sorted(x.k for x in got) == list(range(len(docs)))
    left = Counter((x.doc_id, x.text) for x in got)
    assert sum(n for (_, t), n in left.items() if t in (a, b)) == 1  # of the three rows without an id one line stays
    assert left[8, "once"] == 1 and left[8, ""] == 2 and left[9, "only here\n\n"] == 1 and left[9, "\n"] == 1
    seven = [t for (i, t), n in left.items() if i == 7 for _ in range(n)]
    assert sorted(len(t) for t in seven) == [0, len("under\nseven " + a)]
    assert left[None, None] == 2 and left[None, ""] >= 2
    removed = {x.k: x.n_removed for x in got}
    assert removed[3] + removed[4] == 2 and removed[10] == removed[12] == removed[13] == 0
