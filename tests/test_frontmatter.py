import json
from collections import Counter

from lattix.sources import frontmatter
from lattix.sources.frontmatter import Refused, parsed

NESTED = """# a comment
type: concept
title: "Two: \\u00e9 \\"x\\"" # after
'odd ''key''': yes
empty:
order: 12
scale: 1e3
octal: 012
usage:
  tokens: 7
  deep:
    - - a
      - b
    -
      flag: true
      note: 'it''s'
list:
- x # no
- y#z
flow: [a, "b, c", 'd' , -1 ]
lines: [
  a,  # first
  b
]
block: |
  one

    two
  # kept
fold: >-
  one
  two

  three
    more
  four
keep: |+
  x

plain: goes on
  over: lines
"""


def test_values():
    text = NESTED.replace("over: lines", "over lines")
    types = {"order": "integer", "octal": "integer", "scale": "number", "usage.tokens": "integer", "usage.deep[].flag": "boolean", "flow[]": "integer"}
    want = {
        "type": "concept", "title": 'Two: é "x"', "odd 'key'": "yes", "empty": "", "order": 12, "scale": 1000.0, "octal": "012", "usage": {"tokens": 7, "deep": [["a", "b"], {"flag": True, "note": "it's"}]},
        "list": ["x", "y#z"], "flow": ["a", "b, c", "d", -1], "lines": ["a", "b"], "block": "one\n\n  two\n# kept\n", "fold": "one two\n\nthree\n  more\nfour", "keep": "x\n\n", "plain": "goes on over lines",
    }
    got = parsed(text, types)
    want["fold"] = "one two\nthree\n  more\nfour"
    assert got == want
    assert parsed("") == {} and parsed("# only\n") == {} and parsed("a: b\r\nc:\r\n  - d\r\n") == {"a": "b", "c": ["d"]}
    assert parsed("a: 'x\n\n  y'\nb: \"x \\\n  y\"") == {"a": "x\ny", "b": "x y"}
    assert parsed("a: http://x/y:z\n-b: c") == {"a": "http://x/y:z", "-b": "c"}


def test_refusals():
    cases = {
        "a: &x b": ("anchor", 1, 4), "a: b\nc: *x": ("anchor", 2, 4), "a: !!int 3": ("tag", 1, 4), "<<: x": ("tag", 1, 1), "a: {b: c}": ("construct", 1, 4), "? a": ("construct", 1, 1), "a: b\na: c": ("duplicate-key", 2, 1),
        "a:\n  b: 1\n  b: 2": ("duplicate-key", 3, 3), "a: b\n---\nc: d": ("second-document", 2, 1), "a: [b, [c]]": ("construct", 1, 4), "a: [b": ("construct", 1, 4), "a: b: c": ("construct", 1, 4), "a: 'b": ("construct", 1, 4), "a:\n\t- b": ("construct", 2, 1), "a:\n    b: 1\n  c: 2": ("construct", 3, 3),
        "a: [b, {c: d}]": ("construct", 1, 4), "- a\nb: c": ("construct", 2, 1), "a: 'b' c": ("construct", 1, 4), 'a: "\\q"': None,
    }
    for text, want in cases.items():
        try:
            got = parsed(text)
        except Refused as e:
            got = e.args
        assert (got == want) if want else got[0] == "construct", (text, got)
    deep = "\n".join(" " * i + "a:" for i in range(70))
    try:
        parsed(deep)
        raise AssertionError
    except Refused as e:
        assert e.args[0] == "too-deep"


def test_files(spark, tmp_path):
    files = {
        "a.md": "---\ntype: concept\nrequires:\n  - b\n  - target: c\n    note: x\nuses: [d, d]\nusage:\n  tokens: 7\n---\nBody --- here\n---\n", "b.md": "---\ntype: x\ntype: y\n---\n", "c.md": "no front\n", "d.md": "---\n---\nempty\n", "e.md": "\n", "h.md": "", "f.md": "---\nopen: 1\n", "sub/g.md": "---\nbig: " + "x" * (1 << 20) + "\n---\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    items = frontmatter.read_files(spark, f"file://{tmp_path}", {"usage.tokens": "integer"})
    got = {r.slug: r for r in items.select("slug", "body", "finding", "line", "col", frontmatter.field(items.front, "$.usage.tokens", "long").alias("tokens")).collect()}
    assert {k: r.finding for k, r in got.items()} == {"a": None, "b": "duplicate-key", "c": "no-frontmatter", "d": None, "e": "no-frontmatter", "f": "open-frontmatter", "g": "too-large"}
    assert (got["a"].tokens, got["a"].body, got["d"].body, got["b"].line, got["b"].col) == (7, "Body --- here\n---\n", "empty\n", 3, 1)
    assert {tuple(r) for r in frontmatter.links(items).collect()} == {("a", "requires", "b"), ("a", "requires", "c"), ("a", "uses", "d")}


def test_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "a: [1]")], "id long, text string")
    got = frontmatter.parse(df, "text").collect()
    assert Counter((r.id, None if r.front is None else json.dumps(r.front.toPython()), r.finding) for r in got) == {(1, None, None): 1, (2, "{}", None): 2, (3, '{"a": ["1"]}', None): 1}
    assert frontmatter.parse(df.limit(0), "text").count() == 0
