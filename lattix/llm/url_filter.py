"""URL block and allow rules, spread over redirects and canonical links. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # action (block or allow), host, path

#: A word that the html has, its tag, what the tag has, and where its target is.
LINKS = (
    ("canonical", r"(?i)<link\b[^>]*+>", r"""(?i)\brel\s*=\s*["']?canonical\b""", r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""),
    ("refresh", r"(?i)<meta\b[^>]*+>", r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""", r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""),
)


def _after_scheme(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("__url"))), F.lit(""))


def host_and_path(df: DataFrame, url_col: str) -> DataFrame:
    """Adds host, A-Z lower-cased, and path; both empty for null or a url without ://."""
    rest = _after_scheme(F.col("__url"))
    return (
        df.withColumn("__url", F.col(url_col).cast("string"))
        .withColumn("__rest", rest)
        .withColumn("host", F.translate(F.regexp_extract("__rest", r"^([^/?#]*)", 1), UPPER, LOWER))
        .withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1))
        .drop("__url", "__rest")
    )


def matching_rule(rules: list[Rule]) -> Column:
    """Struct (rule, action) of the longest of a short list of rules that fits columns host and path, else null."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,action:string>")
    listed = F.array(*[F.struct(F.lit(len(h) + len(p)).alias("chars"), F.lit(h + p).alias("rule"), F.lit(a).alias("action"), F.lit(h).alias("h"), F.lit(p).alias("p")) for a, h, p in rules])
    fits = F.filter(listed, lambda r: ((F.col("host") == r["h"]) | F.col("host").endswith(F.concat(F.lit("."), r["h"]))) & F.col("path").startswith(r["p"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["action"].alias("action")))


def node(url: Column) -> Column:
    """What names a page: scheme and fragment left out, host in lower case; null without ://."""
    rest = F.regexp_extract(url, r"^[\s\S]*?://([^#]*)", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?]*)", 1), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.regexp_extract(rest, r"^[^/?]*([\s\S]*)", 1)))


def resolved(target: Column, url: Column) -> Column:
    """A link's target as an absolute url."""
    scheme, site = F.regexp_extract(url, r"^([\s\S]*?)://", 1), F.regexp_extract(url, r"^([\s\S]*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^([\s\S]*?://[^/?#]*(?:[^?#]*/)?)", 1)
    return (
        F.when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(F.regexp_replace(folder, "/?$", "/"), target))
    )


def link_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(a, b) of pages and the canonical or refresh target that their html names; targets in &amp; form are read as &. Of a page's canonical links and of its refreshes the first counts, as in browsers."""
    found = []
    # without what follows the last >, each tag that begins also ends, and no text is scanned twice
    ended = F.left(F.col(html_col), F.length(html_col) - F.length(F.substring_index(html_col, ">", -1)))
    for hint, tag, own_of, pattern in LINKS:
        own = pages.where(F.contains(F.lower(html_col), F.lit(hint)) & (F.instr(url_col, "://") > 0))
        first = F.get(F.filter(F.regexp_extract_all(ended, F.lit(tag), F.lit(0)), lambda x: x.rlike(own_of)), F.lit(0))  # noqa: B023
        target = F.replace(F.regexp_extract(first, pattern, 1), F.lit("&amp;"), F.lit("&"))
        found.append(own.select(F.col(url_col).alias("url"), target.alias("target")).where("target != ''"))
    links = found[0].union(found[1])
    return links.select(node(F.col("url")).alias("a"), node(resolved(F.col("target"), F.col("url"))).alias("b"))


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict (allow or block), by_alias.

    The longest fitting rule decides. A page without a rule takes its verdict from the pages that redirects (from_url,
    to_url), canonical links and refreshes join it to, in any direction and over any number of steps: block if a
    rule blocks one of them and none allows any, else allow. A page's own rule always stands, so an allowed alias of a blocked
    page stays allowed. Null urls and urls without :// have an empty host and path, no alias, and are allowed unless a rule fits.
    Repeated rows are judged alike; an empty table gives no rows.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    edges = link_edges(own, "url", "html")
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("from_url")), node(F.col("to_url"))))
    label = connected_components(edges)
    ruled = host_and_path(label.withColumn("full", F.concat(F.lit("x://"), "vertex")), "full").withColumn("action", matching_rule(rules)["action"])
    root = ruled.groupBy("root").agg(F.max(F.col("action") == "block").alias("blocked"), F.max(F.col("action") == "allow").alias("allowed"))
    spread = label.join(root.where("blocked and not coalesce(allowed, false)").select("root"), "root", "left_semi").select(F.col("vertex").alias("node"), F.lit(True).alias("aliased"))
    judged = host_and_path(own.drop("html"), "url").withColumn("match", matching_rule(rules)).withColumn("node", node(F.col("url")))
    by_alias = F.col("match").isNull() & F.coalesce("aliased", F.lit(False))
    verdict = F.coalesce(F.col("match.action"), F.when(by_alias, "block").otherwise("allow"))
    return judged.join(spread, "node", "left").select("page_id", "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"), by_alias.alias("by_alias"))
