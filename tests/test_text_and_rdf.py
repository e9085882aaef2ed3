from pyspark.sql import functions as F

from lattix.functions import metrics, text
from lattix.operators import ledger, rdf


def test_tokens_lower_ascii_only(spark):
    df = spark.createDataFrame([("The ÉTÉ, x a1-b2 ж9!",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.tokens(F.col("t"))).collect()] == [["the", "ÉtÉ", "a1", "b2", "ж9"], None, []]


def test_search_scores_and_order(spark):
    docs = spark.createDataFrame([("b", "red blue"), ("a", "red blue"), ("c", "red red"), ("d", "none")], "slug string, text string")
    posted = text.postings(docs, "slug", "text")
    assert [(r.slug, r.score) for r in text.search(posted, "red blue red").collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert [(r.slug, r.score) for r in text.search(posted, "red blue red", repeated=True).collect()] == [("a", 3), ("b", 3), ("c", 2)]
    assert text.search(posted, "").count() == 0


def test_sections_skip_fenced_headings(spark):
    body = "intro\n```\n## not one\n```\n## One ##\nx\n### Two\n"
    df = spark.createDataFrame([("s", body), ("n", None), ("e", "")], "slug string, body string")
    got = [(r.slug, r.section, r.title, r.body) for r in text.sections(df, "slug", "body").orderBy("section").collect()]
    assert got == [("s", 0, "", "intro\n```\n## not one\n```"), ("s", 1, "One", "x"), ("s", 2, "Two", "")]


def test_cut_by_size_keeps_every_character():
    for body in ("é" * 5000, "a\n" * 4000, "p\n\n" * 3000, "", "x" * 4096):
        parts = text.cut_by_size(body)
        assert "".join(parts) == body and all(len(p.encode()) <= 4096 for p in parts)


def test_slugs(spark):
    df = spark.createDataFrame([(1, "Hello, World!"), (2, "--"), (3, None), (4, "x" * 80), (5, "hello world")], "k int, t string")
    got = {r.k: r.slug for r in text.numbered_slugs(df.withColumn("base", text.slugify(F.col("t"))), "base", "k").collect()}
    assert got == {1: "hello-world", 2: "note", 3: "note-2", 4: "x" * 64, 5: "hello-world-2"}


def test_lines_round_trip(spark):
    df = spark.createDataFrame([("a", "p", 'say "hi"\n\\x\t'), ("a", "q", "b")], "s string, p string, o string")
    back = rdf.parse_lines(rdf.lines(df, "urn:", F.col("p") == "p").withColumnRenamed("line", "value"))
    assert {(r.s, r.p, r.o, r.kind) for r in back.collect()} == {("urn:a", "urn:p", 'say "hi"\n\\x\t', "literal"), ("urn:a", "urn:q", "urn:b", "iri")}


def test_rule_closure_is_a_fixpoint(spark):
    t = spark.createDataFrame([("a", "part", "b"), ("b", "part", "c"), ("c", "near", "d")], "s string, p string, o string")
    v = spark.createDataFrame([("transitive", "part", "part"), ("symmetric", "near", "near"), ("inverseOf", "part", "whole"), ("domain", "part", "Thing"), ("subClassOf", "Thing", "Top")], "rule string, a string, b string")
    got = {(r.s, r.p, r.o) for r in rdf.rule_closure(t, v).collect()}
    assert {("a", "part", "c"), ("c", "whole", "a"), ("d", "near", "c"), ("a", "rdf:type", "Top")} <= got
    assert {(r.s, r.p, r.o) for r in rdf.rule_closure(rdf.rule_closure(t, v), v).collect()} == got


def test_patterns_join_and_repeat_variables(spark):
    t = spark.createDataFrame([("a", "p", "a"), ("a", "p", "b"), ("b", "q", "c")], "s string, p string, o string")
    assert [tuple(r) for r in rdf.match(t, ("?x", "p", "?x")).collect()] == [("a",)]
    assert {(r.x, r.y) for r in rdf.match(t, ("?x", "p", "?z"), ("?z", "q", "?y")).collect()} == {("a", "c")}


def test_ledger_finds_changes(spark):
    e = spark.createDataFrame([("l", i, f"b{i}") for i in range(5)] + [("m", 0, "only")], "ledger string, n int, body string")
    chained = ledger.chain(e, "ledger", ["n"], "body")
    assert ledger.verify(chained, "ledger").count() == 0
    cut = chained.where("not (ledger = 'l' and seq = 2)")
    assert [tuple(r) for r in ledger.verify(cut, "ledger").collect()] == [("l", 3, "prev")]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", 1, "x"), ("q", 2, "a"), ("q", 3, "b"), ("r", 1, "a")], "qid string, rank int, id string")
    gold = spark.createDataFrame([("q", "a"), ("q", "b"), ("z", "a")], "qid string, id string")
    got = {r.qid: r for r in metrics.ranking(ranked, gold, 3).collect()}
    assert set(got) == {"q", "z"} and got["q"].rr == 0.5 and got["q"].recall == 1 and abs(got["q"].ap - (1 / 2 + 2 / 3) / 2) < 1e-12 and got["z"].ndcg == 0
    a, b = spark.createDataFrame([(1.0,), (3.0,), (3.0,)], "v double"), spark.createDataFrame([(2.0,), (3.0,)], "v double")
    assert metrics.cliffs_delta(a, b, "v").first()[0] == round((-1 - 1 + 1 + 0 + 1 + 0) / 6, 4)
    low, high = metrics.bootstrap(spark.range(1000).selectExpr("id", "cast(id % 10 as double) v"), "id", "v").first()
    assert 4.1 < low < 4.5 < high < 4.9


def test_escapes_are_read_once_and_in_order(spark):
    """What lines() writes comes back as it was, for every kind of character; \\u and \\U are read; what looks like an escape after a backslash isn't one."""
    texts = ["C:\\temp\\new", "\\\\n", 'say "x"\\', "tab\tline\nreturn\rfeed\x0cback\x08", "é😀\u2028 ", "\\u0041", "", "'"] + [chr(c) for c in (*range(1, 0x180), 0xD7FF, 0xE000, 0xFFFD, 0x10000, 0x10FFFF)]
    df = spark.createDataFrame([(f"s{i}", "p", t) for i, t in enumerate(texts)], "s string, p string, o string")
    back = rdf.parse_lines(rdf.lines(df, "urn:", F.lit(True)).withColumnRenamed("line", "value"))
    assert {r.s: r.o for r in back.collect()} == {f"urn:s{i}": t for i, t in enumerate(texts)}
    foreign = r"""<urn:\u00e9> <urn:p> "\u0041\U0001F600\\u0041\t\b\'\"\\t"@en-GB <urn:g\u0020x> .
<urn:a> <urn:p> "1"^^<urn:int> ."""
    got = rdf.parse_lines(spark.createDataFrame([(x,) for x in foreign.split("\n")], "value string")).collect()
    assert [(r.s, r.o, r.lang, r.g, r.datatype) for r in sorted(got, key=lambda r: r.s == "urn:a")] == [("urn:é", "A😀\\u0041\t\b'\"\\t", "en-GB", "urn:g x", None), ("urn:a", "1", None, None, "urn:int")]


def test_sections_of_a_long_document(spark):
    """40,000 lines, every fourth a heading: each section has its own lines, and time goes with the lines."""
    lines = [f"## head {i} ##" if i % 4 == 0 else f"line {i}" for i in range(1, 40_001)]
    got = {r.section: r for r in text.sections(spark.createDataFrame([("d", "\n".join(lines)), ("e", None), ("f", "")], "slug string, body string"), "slug", "body").collect()}
    assert len(got) == 10_001 and got[0].body == "line 1\nline 2\nline 3" and got[7].title == "head 28" and got[7].body == "line 29\nline 30\nline 31" and got[10_000].body == ""
