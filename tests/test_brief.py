"""The brief of a small composition, every kind of gap and of entry, written out by hand."""

from lattix.operators import brief

LINKS = [("a", "uses", "out"), ("a", "uses", "b"), ("b", "related", "out"), ("far", "related", "a"), ("new", "supersedes", "b"), ("c", "contradicts", "a"), ("a", "contradicts", "c"), ("c", "contradicts", "b"), ("a", "requires", "c"),
         ("c", "broader", "a"), ("t", "verifies", "a"), ("b", "blocked-by", "x"), ("b", "uses", "hidden"), ("b", "requires", "a"), ("d", "contradicts", "out")]


def test_brief(spark):
    authored = spark.createDataFrame(LINKS, "source string, key string, target string")
    listed = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "out", "far", "new", "t", "x")], "slug string")
    members = spark.createDataFrame([("a", True, "2030-01-01", "stable"), ("b", False, "2020-01-01", "deprecated"), ("c", True, None, "stable"), ("d", None, None, None)], "slug string, sources boolean, stale_after string, status string")
    related = brief.relations(authored, listed, members)
    got = {(r.source, r.key, r.target): (r.origin, r.scope) for r in related.collect()}
    assert got["a", "uses", "out"] == ("authored", "outside") and got["b", "used-by", "a"] == ("inverse", "inside") and got["a", "related", "far"] == ("symmetric", "outside") and got["a", "contradicts", "c"] == ("authored", "inside")
    assert not any("hidden" in k for k in got) and len(got) == 2 * (len(LINKS) - 1) - 2
    unmet = spark.createDataFrame([("a", "port"), ("out", "other")], "source string, target string")
    lacking = brief.gaps(related, members, unmet, "2026-01-01")
    assert {tuple(r) for r in lacking.collect()} == {
        ("uses-not-selected", "a", "out"), ("related-not-selected", "b", "out"), ("related-not-selected", "a", "far"), ("port-without-producer", "a", "port"), ("no-sources", "b", None), ("no-sources", "d", None),
        ("stale", "b", None), ("deprecated", "b", None), ("replaced-outside", "b", "new"), ("contradiction", "a", "c"), ("contradiction", "c", "b"),
    }
    todo = brief.checklist(related, members, lacking, spark.createDataFrame([("a", "b")], "a string, b string")).collect()
    # a and c wait on each other and b on a, so d is free first and then the least is taken
    assert [r.slug for r in sorted((r for r in todo if r.kind == "adopt"), key=lambda r: r.place)] == ["d", "a", "b", "c"]
    assert {(r.kind, r.slug, r.target) for r in todo if r.kind != "adopt"} == {("provide-port", "a", "port"), ("decide", "a", "c"), ("decide", "c", "b"), ("verify", "a", "t"), ("unblock", "b", "x"), ("resolve", "a", "b")}
