"""Shapes from a table and from triples, each component with what breaks and what keeps it."""

from lattix.operators import rdf, shapes

DATA = """ann rdf:type Person iri
ann name "Ann" str
ann age "30" int
ann knows bob iri
bob rdf:type Employee iri
bob name "B" str
bob name "Bobby the very long" str
bob age "old" str
bob knows ann iri
bob boss ann iri
cat rdf:type Cat iri
cat name "Tom" str
cat knows _:x iri
Employee rdfs:subClassOf Person iri
ann likes "tea" str
bob likes "gin" str
ann home h1 iri
h1 city "Ulm" str
bob home h2 iri
h2 city "Bonn" str
h2 rdf:type House iri"""
SHAPES = """Person targetClass Person
Person property _:name
Person property _:age
Person property _:home
_:name path name
_:name minCount 1
_:name maxCount 1
_:name minLength 2
_:name maxLength 10
_:name pattern ^[A-Z][a-z]+$
_:age path age
_:age datatype int
_:age nodeKind Literal
_:home path home
_:home class House
Liked targetObjectsOf likes
Liked in tea
Liked in milk
Liked severity Warning
Known targetSubjectsOf knows
Known property KnownBy
KnownBy path ^knows
KnownBy minCount 1
KnownBy nodeKind IRI
City targetNode ann
City targetNode bob
City targetNode nobody
City path home city
City hasValue Ulm
Boss targetSubjectsOf boss
Boss path boss
Boss node Nice
Nice property NiceName
NiceName path name
NiceName in Zoe
NiceName flags i
Any targetNode cat
Any path knows
Any nodeKind BlankNodeOrLiteral
Any maxLength 5
Any node Loop
Loop property Loop2
Loop2 path knows
Loop2 node Loop"""


def triples(spark):
    rows = []
    for line in DATA.split("\n"):
        s, p, rest = line.split(" ", 2)
        o, kind = rest.rsplit(" ", 1)
        o = o.strip('"')
        rows.append((s, p, o, "literal" if kind != "iri" else "blank" if o.startswith("_:") else "iri", None if kind == "iri" else kind))
    return spark.createDataFrame([*rows, rows[0], (None, "p", "o", "iri", None)], "s string, p string, o string, kind string, datatype string")


WANT = {
    ("bob", "Person > name", "name", "maxCount", None, "Violation"),
    ("bob", "Person > name", "name", "minLength", "B", "Violation"),
    ("bob", "Person > name", "name", "pattern", "B", "Violation"),
    ("bob", "Person > name", "name", "maxLength", "Bobby the very long", "Violation"),
    ("bob", "Person > name", "name", "pattern", "Bobby the very long", "Violation"),
    ("bob", "Person > age", "age", "datatype", "old", "Violation"),
    ("ann", "Person > home", "home", "class", "h1", "Violation"),
    ("gin", "Liked", None, "in", "gin", "Warning"),
    ("cat", "KnownBy", "^knows", "minCount", None, "Violation"),
    ("bob", "City", "home city", "hasValue", None, "Violation"),
    ("nobody", "City", "home city", "hasValue", None, "Violation"),
    ("bob", "Boss", "boss", "node", "ann", "Violation"),
    ("cat", "Any", "knows", "maxLength", "_:x", "Violation"),
}


def test_every_component_from_one_table(spark):
    table = spark.createDataFrame([tuple(x.split(" ", 2)) for x in SHAPES.split("\n")], "shape string, parameter string, value string")
    assert {tuple(r) for r in shapes.report(table, triples(spark)).collect()} == WANT
    none = table.limit(0)
    assert shapes.report(none, triples(spark)).count() == 0
    assert {r.component for r in shapes.report(table, triples(spark).limit(0)).collect()} == {"hasValue"}


def test_shapes_from_triples(spark):
    sh, ns = shapes.SH, shapes.RDF
    lines = f"""<S> <{sh}property> _:p .
_:p <{sh}path> _:seq .
_:seq <{ns}first> <home> .
_:seq <{ns}rest> _:s2 .
_:s2 <{ns}first> _:inv .
_:s2 <{ns}rest> <{ns}nil> .
_:inv <{sh}inversePath> <city> .
_:p <{sh}in> _:l .
_:l <{ns}first> "a" .
_:l <{ns}rest> _:l2 .
_:l2 <{ns}first> "b" .
_:l2 <{ns}rest> <{ns}nil> .
_:p <{sh}nodeKind> <{sh}IRI> .
_:p <{sh}closed> "true" .
<S> <{sh}targetClass> <C> ."""
    parsed = rdf.parse_lines(spark.createDataFrame([(x,) for x in lines.split("\n")], "value string"))
    got = {tuple(r) for r in shapes.shapes_of(parsed).collect()}
    assert got == {("S", "property", "_:p"), ("_:p", "path", "home ^city"), ("_:p", "in", "a"), ("_:p", "in", "b"), ("_:p", "nodeKind", "IRI"), ("S", "targetClass", "C")}
