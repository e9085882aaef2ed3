from collections import Counter

import pytest

from lattix.operators import rdf
from lattix.sources import exchange
from lattix.sources.turtle import RDF, XSD, read_turtle, resolved

TEXT = '''# a comment with . and """ in it
@prefix : <http://e/> .
@prefix x: <sub/> . @base <http://base/dir/> .
:a a :T ; x:p "one. two" , 'it''s'@en-GB , """long . "quoted"
 # no comment
 @prefix x: <http://no/> .""" ; :n 1 , -2.50 , 3e4 , true .
:a.b :p <rel> , <#f> , "t"^^x:t , "\\u00e9\\n\\\\t" .
PREFIX x: <http://later/>
BASE <more/>
x:c\\,d :p \'\'\'two
"""lines\'\'\' , <rel> .
_:n :p [ :q ( 1 :b ) ; :r [] ] . [] :s _:n .
<http://f#g> :p x:h%20i . x: : :.
'''.replace("it''s", "its")

E, B = "http://e/", "http://base/dir/"
NAMED = {
    (f"{E}a", f"{RDF}type", f"{E}T", "iri", None, None), (f"{E}a", "http://start/sub/p", "one. two", "literal", None, None), (f"{E}a", "http://start/sub/p", "its", "literal", None, "en-GB"),
    (f"{E}a", "http://start/sub/p", 'long . "quoted"\n # no comment\n @prefix x: <http://no/> .', "literal", None, None),
    (f"{E}a", f"{E}n", "1", "literal", f"{XSD}integer", None), (f"{E}a", f"{E}n", "-2.50", "literal", f"{XSD}decimal", None), (f"{E}a", f"{E}n", "3e4", "literal", f"{XSD}double", None), (f"{E}a", f"{E}n", "true", "literal", f"{XSD}boolean", None),
    (f"{E}a.b", f"{E}p", f"{B}rel", "iri", None, None), (f"{E}a.b", f"{E}p", f"{B}#f", "iri", None, None), (f"{E}a.b", f"{E}p", "t", "literal", "http://start/sub/t", None), (f"{E}a.b", f"{E}p", "é\n\\t", "literal", None, None),
    ("http://later/c,d", f"{E}p", 'two\n"""lines', "literal", None, None), ("http://later/c,d", f"{E}p", f"{B}more/rel", "iri", None, None), ("http://f#g", f"{E}p", "http://later/h%20i", "iri", None, None), ("http://later/", E, E, "iri", None, None),
}


@pytest.fixture
def blocks(spark, request):
    """Blocks of few bytes, so that statements, strings and prefixes cross their bounds."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    old = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, [str(request.param), "1", "1"]):
        spark.conf.set(n, v)
    yield request.param
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("blocks", [120, 1 << 27], indirect=True)
def test_statements_cross_blocks(spark, tmp_path, blocks):
    (tmp_path / "a.ttl").write_text(TEXT, encoding="utf-8")
    (tmp_path / "b.ttl").write_text("@prefix : <http://other/> .\n_:n :p :o .\n", encoding="utf-8")
    got = read_turtle(spark, f"file://{tmp_path}", "http://start/x").collect()
    assert [r for r in got if r.finding] == []
    term = [tuple(r)[1:7] for r in got if not r.s.startswith("_:")]
    assert Counter(term) == Counter(NAMED)
    blank = [r for r in got if r.s.startswith("_:")]
    other = [r for r in blank if r.path.endswith("b.ttl")]
    assert [(r.p, r.o) for r in other] == [("http://other/p", "http://other/o")]
    of = {(r.s, r.p): r.o for r in blank if r.path.endswith("a.ttl")}
    node = next(s for s, p in of if p == f"{E}p")
    assert node != other[0].s and sum(o == node for o in of.values()) == 1
    inner = of[node, f"{E}p"]
    cell = of[inner, f"{E}q"]
    second = of[cell, f"{RDF}rest"]
    assert (of[cell, f"{RDF}first"], of[second, f"{RDF}first"], of[second, f"{RDF}rest"]) == ("1", f"{E}b", f"{RDF}nil")
    assert of[inner, f"{E}r"].startswith("_:") and len(of) == 8


def test_findings_and_empty_files(spark, tmp_path):
    bad = ["<a> <b> .", '<a> "x" <b> .', "<a> <b> <c> <d> .", "<a> <b> ( <c> .", "<a> <b> ] .", "y:a <b> <c> , <d> .", "[] .", "<a> <b> a .", "@prefix <a> .", "<a> <b> {} ."]
    (tmp_path / "a.ttl").write_text("\n".join([*bad, "<s> <p> <o> , <o> ."]) + '\n<a> <b> """open', encoding="utf-8")
    (tmp_path / "b.ttl").write_text("", encoding="utf-8")
    (tmp_path / "c.ttl").write_text("# nothing\n\n", encoding="utf-8")
    got = read_turtle(spark, f"file://{tmp_path}").collect()
    assert sorted(r.o.strip() for r in got if r.finding) == sorted([*bad, '<a> <b> """open'])
    assert [(r.s, r.p, r.o) for r in got if not r.finding] == [("s", "p", "o")] * 2
    assert all(r.s is None and r.kind is None for r in got if r.finding)


@pytest.mark.parametrize("blocks", [700], indirect=True)
def test_round_trip_of_all_kinds_of_characters(spark, tmp_path, blocks):
    points = [*range(1, 0x250), 0x2028, 0xFFFD, 0x1F600, 0x10FFFF]
    texts = ["".join(chr(c) for c in points[i : i + 16]) for i in range(0, len(points), 16)] + ["", '"', '""" .', "\\", "'''", "a\\", "\\u0041", "@prefix x: <y> ."]
    rows = [(f"http://e/{i}", "http://e/p", t, True) for i, t in enumerate(texts)] + [(f"http://e/{i}", "http://e/q", "http://e/o", False) for i in range(9)]
    df = spark.createDataFrame(rows, "s string, p string, o string, l boolean")
    exchange.turtle(df, df.l).write.text(f"file://{tmp_path}/out")
    got = read_turtle(spark, f"file://{tmp_path}/out").collect()
    assert Counter((r.s, r.p, r.o, r.kind == "literal") for r in got) == Counter(rows)
    lines = rdf.parse_lines(rdf.lines(df, "", df.l), "line")
    assert Counter((r.s, r.p, r.o) for r in lines.collect()) == Counter(r[:3] for r in rows)


def test_references():
    base = "http://a/b/c/d;p?q"
    want = {"g": "b/c/g", "./g": "b/c/g", "g/": "b/c/g/", "/g": "g", "?y": "b/c/d;p?y", "g?y": "b/c/g?y", "#s": "b/c/d;p?q#s", "": "b/c/d;p?q", "../g": "b/g", "../../../g": "g", ".": "b/c/", "..": "b/", "g;x=1/../y": "b/c/y", "/./g": "g"}
    assert {r: resolved(base, r) for r in want} == {r: f"http://a/{w}" for r, w in want.items()}
    assert (resolved(base, "//h"), resolved(base, "u:x"), resolved(None, "g"), resolved("http://a", "g")) == ("http://h", "u:x", "g", "http://a/g")
