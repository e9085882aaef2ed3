"""Operators 11 to 13 against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from lattix.llm import periodic_runs, prefix_trie, queries, simhash_dedup
from tests.llm.cases import corpus, frame, words

# periodic runs


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            if size >= max(6, 4 * q) and all(any(w[k] != w[k + d] for k in range(s, s + size - d)) for d in range(1, q)):
                out.append((s, size, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(count):
    r = random.Random(5)
    for _ in range(count):
        letters = r.randint(1, 4)
        w = [r.randrange(letters) for _ in range(r.randint(0, 60))]
        if r.random() < 0.5 and len(w) > 10:
            block = w[: r.randint(1, 8)]
            w = w[:5] + block * r.randint(3, 9) + w[5:15] + block * r.randint(2, 5)
        yield w
    for block in ([0], [0, 1], [0, 1, 0, 0, 1]):
        yield block * 60
    long = [r.randrange(9) for _ in range(40)]
    yield long * 4 + long[:7] + [9] + long * 5
    yield [0] * 30 + [1] + [0] * 30


def test_runs_are_those_of_brute_force():
    for w in sequences(1500):
        assert periodic_runs.runs_of(w) == brute_runs(w)


def test_stretches_hold_all_runs():
    texts = [[b"%d" % x for x in w] for w in sequences(300)]
    got = defaultdict(list)
    for doc, start, end in periodic_runs.stretches(texts):
        got[doc] += [(start + s, size, q) for s, size, q in periodic_runs.runs_of([int(x) for x in texts[doc][start:end]])]
    for k, w in enumerate(texts):
        assert sorted(got[k], key=lambda r: (r[0], r[2])) == brute_runs(w)


def test_words_decide_when_hashes_meet(monkeypatch):
    r = random.Random(1)
    w = [r.randrange(2) for _ in range(12)] * 5
    bases = iter([0, *range(7, 99)])  # all prefix hashes under base 1 of equal sums meet
    monkeypatch.setattr(periodic_runs.textscan, "numbered", lambda n, seed: [next(bases)])
    for _ in range(20):
        w = w[3:] + [r.randrange(2) for _ in range(3)]
        assert periodic_runs.runs_of(w) == brute_runs(w)


def test_find_runs_of_awkward_rows(spark):
    rows = corpus()
    block = "round and round it goes "
    rows += [(200, block * 6 + "home", "en", "a", 1, 1, 1, "x", 0.1), (None, "a " * 9, "en", "a", 1, 1, 1, "x", 0.1), (201, "b\tb\nb\rb\x0bb\x0cb", None, None, None, 1, 1, "x", 0.1), (202, " ".join(words(random.Random(3), 500) for _ in range(1)) + " " + "x y " * 20000, "en", "a", 1, 1, 1, "x", 0.1)]
    got = periodic_runs.find_runs(frame(spark, rows)).collect()
    assert len(got) == len(rows)

    def right(doc_id, text):
        w = (text or "").encode().split()
        found = brute_runs(w) if len(w) < 20000 else None
        return doc_id, len(w), found

    want = Counter((i, n, str(f)) for i, n, f in (right(r[0], r[1]) for r in rows) if f is not None)
    assert Counter((g.doc_id, g.n_words, str([tuple(r) for r in g.runs])) for g in got if g.n_words < 20000) == want
    long = next(g for g in got if g.n_words > 20000)
    assert [tuple(r) for r in long.runs][-1][1:] == (40000, 2)
    assert next(g for g in got if g.doc_id == 200).collapsed == block + "home"
    assert next(g for g in got if g.doc_id == 103).collapsed == ""
    assert periodic_runs.find_runs(frame(spark, []), "doc_id", "text").count() == 0


def test_op12_rows(spark, tmp_path):
    rows = corpus(n=150)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")

    def right(doc_id, text):
        w = (text or "").encode().split()
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        return (doc_id, len(runs), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())

    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r) for r in got.collect()]
    assert Counter(got) == Counter(right(r[0], r[1]) for r in rows)
    assert any(r[1] for r in got)


# SimHash


def brute_fingerprint(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reached(points, bits):
    """The least other point that links lead to, for each point, by flooding."""
    root, left = {}, set(points)
    while left:
        first = left.pop()
        group, stack = [first], [first]
        while stack:
            x = stack.pop()
            near = {y for y in left if bin(x ^ y).count("1") <= bits}
            left -= near
            stack += near
            group += near
        for x in group:
            root[x] = min(group)
    return root


def test_near_components_against_all_pairs(spark):
    r, rows = random.Random(2), corpus()
    base = words(r, 300, [f"w{i}" for i in range(500)]).split()
    for i in range(60):
        rows.append((300 + i, " ".join(x if r.random() > 0.004 else "changed" for x in base), "en", "a", 1, 1, 1, "x", 0.1))
    rows += [(None, rows[-1][1].upper(), None, None, None, 1, 1, "x", 0.1), (None, "quite alone here", None, None, None, 1, 1, "x", 0.1)]
    got = [tuple(x) for x in simhash_dedup.near_components(frame(spark, rows)).collect()]
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    root = reached({f for _, f in prints}, 3)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    assert Counter(got) == Counter((i, signed(f), least.get(root[f])) for i, f in prints)
    assert max(Counter(c for *_, c in got).values()) >= 50
    assert simhash_dedup.near_components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("many", [2, 128])
def test_crowded_choices_go_on_to_finer_ones(spark, many):
    """Many fingerprints in a narrow place: no choice of six blocks tells them apart."""
    r = random.Random(4)
    center = r.getrandbits(64)
    points = {center ^ sum(1 << b for b in r.sample(range(0, 60, 4), r.randint(0, 5))) for _ in range(250)} | {r.getrandbits(64) for _ in range(50)}
    signed = {p - (1 << 64) if p >> 63 else p for p in points}
    classes = simhash_dedup.written(spark.createDataFrame([(x,) for x in signed], "fp long"), "points")
    got = [frozenset((x.a, x.b)) for x in simhash_dedup.linked_fingerprints(classes, many=many).collect()]
    listed = sorted(signed)
    want = {frozenset((a, b)) for k, a in enumerate(listed) for b in listed[k + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert set(got) == want
    assert many != 128 or max(Counter(got).values()) <= len(simhash_dedup.SCHEMES)  # once in each scheme


# prefix trie

TURNS = "conv_id long, turn long, role string, text string, name string, depth int"


def conversations():
    r, rows = random.Random(8), []
    for c in [0, 1, 2, 3, 50, 99, 100, 101, 102, 150, 250, 251, 305]:
        for t in range(r.randint(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "b", ""]), "n", 1))
    for c in (400, 401, 402, 500, 501):  # equal conversations, a long one
        rows += [(c, t, "user", f"t{t % 3}", "n", 1) for t in range(40 if c == 402 else 12)]
    rows += [(600, None, "user", "first", "n", 1), (600, 1, None, None, "n", 1), (600, 1, None, None, "n", 1), (600, 1, "user", "tie", "n", 1), (None, 1, "user", "nobody", "n", 1), (700, 0, "user", "x" * 20000, None, None)]
    return rows


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, w in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + w[h:]
    members = defaultdict(list)
    for c, w in built.items():
        for d in range(len(w) + 1):
            members[tuple(w[:d])].append(c)
    out = []
    for node, own_ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in members if len(x) == len(node) + 1 and x[:-1] == node]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[:-1] == x for y in below)]
        ends = ",".join(str(c) for c in sorted(own_ids) if len(built[c]) == len(node))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((min(own_ids), len(node), min(members[node[:-1]]) if node else None, len(own_ids), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_trie_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    rows = conversations()
    spark.createDataFrame(rows, TURNS).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_prefix_trie(spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_trie(rows))


def test_trie_without_broadcasts_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", 0)
    rows = [(c, t, "user", f"{t if t < 5 else c}") for c in range(6) for t in range(7)]
    turns = spark.createDataFrame(rows, "conv_id long, pos long, role string, text string")
    got = {(r.conv_id, r.depth): r for r in prefix_trie.trie(turns).collect()}
    assert len(got) == 6 + 2 * 6 and got[0, 0].n_leaves == 6 and got[0, 5].n_children == 6 and got[3, 7].parent_conv_id == 3
    assert prefix_trie.trie(turns.limit(0)).count() == 0
    alone = prefix_trie.trie(turns.limit(0), spark.createDataFrame([(5,), (5,), (None,)], "conv_id long")).collect()
    assert [tuple(r) for r in alone] == [(5, 0, None, 1, 0, 1, 0, hashlib.sha256(b"5").hexdigest())]


def test_numbers_are_dense(spark):
    rows, count = prefix_trie.numbered(spark.range(1000).where("id % 7 < 3").repartition(6), "dense")
    assert count == rows.count() and sorted(r.number for r in rows.collect()) == list(range(count))
