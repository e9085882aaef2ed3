"""The test tables as a collection of linked items: the same views as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: So many labels at most are broadcast to their documents.
SENT = 500_000
#: Each view's SQL; WITH them, a query's SQL follows.
SQL = {
    "v_tasks": """SELECT 'order-' || o_orderkey AS slug, CASE o_orderstatus WHEN 'F' THEN 'TASK_STATE_COMPLETED' WHEN 'O' THEN CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'TASK_STATE_INPUT_REQUIRED' WHEN '5-LOW' THEN 'TASK_STATE_AUTH_REQUIRED' ELSE 'TASK_STATE_SUBMITTED' END ELSE 'TASK_STATE_WORKING' END AS state,
        n_name AS cluster, 'customer-' || o_custkey AS claimant, o_orderdate AS modified, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "v_blocked": """SELECT source, target FROM (SELECT o_orderkey AS source, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target FROM orders) WHERE target IS NOT NULL""",
    "v_requires": """SELECT p_partkey AS source, p_partkey // 2 AS target FROM part WHERE p_partkey // 2 IN (SELECT p_partkey FROM part) AND p_partkey // 2 <> p_partkey""",
    "v_supersedes": """SELECT source, target FROM (SELECT p_partkey AS source, lag(p_partkey) OVER (PARTITION BY p_name, p_type ORDER BY p_partkey) AS target FROM part) WHERE target IS NOT NULL""",
    "v_excludes": """SELECT a.p_partkey AS source, b.p_partkey AS target FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey""",
    "v_uses": """SELECT p_partkey AS source, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) + 1 AS target FROM part WHERE p_size % 5 = 0""",
    "v_produces": """SELECT DISTINCT l_suppkey AS producer, p_brand AS port FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_consumes": """SELECT DISTINCT o_custkey AS consumer, p_brand AS port FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49""",
    "v_broader": """SELECT 'nation-' || n_nationkey AS source, 'region-' || n_regionkey AS target FROM nation UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey FROM customer""",
    "v_derived": """SELECT conv_id * 10000 + turn AS source, conv_id * 10000 + turn - 1 AS target FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)""",
    "v_episodes": """SELECT event_id, 'user-' || user_id AS actor, ts AS started, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'partial' END AS outcome, value AS cost_usd FROM events""",
    "v_items": """SELECT 'doc-' || d.doc_id AS slug, d.doc_id AS k, text AS body, lang, source AS cluster, split_part(text, chr(10), 1) AS title,
        CASE WHEN l.doc_id IS NULL THEN 'draft' WHEN toxic = 1 THEN 'retired' ELSE 'stable' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_links": """SELECT 'part-' || source AS source, 'requires' AS key, 'part-' || target AS target FROM v_requires UNION ALL SELECT 'part-' || source, 'supersedes', 'part-' || target FROM v_supersedes
        UNION ALL SELECT 'part-' || source, 'uses', 'part-' || target FROM v_uses UNION ALL SELECT 'part-' || p_partkey, 'related', 'part-' || (p_partkey + 100000) FROM part WHERE p_size = 1""",
    "v_triples": """SELECT 'customer-' || c_custkey AS s, 'rdf:type' AS p, 'Customer' AS o FROM customer UNION ALL SELECT 'customer-' || c_custkey, 'inNation', 'nation-' || c_nationkey FROM customer
        UNION ALL SELECT 'nation-' || n_nationkey, 'rdf:type', 'Nation' FROM nation UNION ALL SELECT 'nation-' || n_nationkey, 'inRegion', 'region-' || n_regionkey FROM nation
        UNION ALL SELECT 'region-' || r_regionkey, 'rdf:type', 'Region' FROM region UNION ALL SELECT 'nation-' || n_nationkey, 'label', n_name FROM nation
        UNION ALL SELECT 'customer-' || c_custkey, 'segment', c_mktsegment FROM customer""",
}
NEEDS = {"v_links": ("v_requires", "v_supersedes", "v_uses")}


def with_views(sql: str) -> str:
    """The SQL behind those views that it names; RECURSIVE does no harm."""
    names = [n for n in SQL if n in sql]
    names = [n for n in SQL if n in {*names, *(m for x in names for m in NEEDS.get(x, ()))}]
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH RECURSIVE {views}, {body[5:].removeprefix('RECURSIVE ')}" if views else body
    return f"WITH {views} {body}" if views else body


class Tables:
    """The tables and views of a folder as DataFrames, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("v_"):
            return globals()[f"_{name[2:]}"](self)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _name(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _tasks(t: Tables) -> DataFrame:
    open_ = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "TASK_STATE_INPUT_REQUIRED").when(F.col("o_orderpriority") == "5-LOW", "TASK_STATE_AUTH_REQUIRED").otherwise("TASK_STATE_SUBMITTED")
    state = F.when(F.col("o_orderstatus") == "F", "TASK_STATE_COMPLETED").when(F.col("o_orderstatus") == "O", open_).otherwise("TASK_STATE_WORKING")
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(_name("order-", "o_orderkey").alias("slug"), state.alias("state"), F.col("n_name").alias("cluster"), _name("customer-", "o_custkey").alias("claimant"), F.col("o_orderdate").alias("modified"), F.col("o_orderkey").alias("k"))


def _blocked(t: Tables) -> DataFrame:
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select(F.col("o_orderkey").alias("source"), before.alias("target")).where("target is not null")


def _requires(t: Tables) -> DataFrame:
    pairs = t.part.select(F.col("p_partkey").alias("source"), F.expr("p_partkey div 2").alias("target")).where("source != target")
    return pairs.join(t.part.select(F.col("p_partkey").alias("target")), "target", "left_semi").select("source", "target")


def _supersedes(t: Tables) -> DataFrame:
    before = F.lag("p_partkey").over(Window.partitionBy("p_name", "p_type").orderBy("p_partkey"))
    return t.part.select(F.col("p_partkey").alias("source"), before.alias("target")).where("target is not null")


def _excludes(t: Tables) -> DataFrame:
    like = ["p_brand", "p_size", "p_type"]
    a, b = t.part.select(F.col("p_partkey").alias("source"), *like), t.part.select(F.col("p_partkey").alias("target"), *like)
    return a.join(b, like).where("source < target").select("source", "target")


def _uses(t: Tables) -> DataFrame:
    many = F.broadcast(t.part.agg(F.count("*").alias("n")))  # one row
    return t.part.where("p_size % 5 = 0").crossJoin(many).select(F.col("p_partkey").alias("source"), F.expr("(p_partkey * 7 + 3) % n + 1").alias("target"))


def _produces(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("producer"), F.col("p_brand").alias("port")).distinct()


def _consumes(t: Tables) -> DataFrame:
    lines = t.lineitem.where("l_quantity >= 49").join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("o_custkey").alias("consumer"), F.col("p_brand").alias("port")).distinct()


def _broader(t: Tables) -> DataFrame:
    nations = t.nation.select(_name("nation-", "n_nationkey").alias("source"), _name("region-", "n_regionkey").alias("target"))
    return nations.union(t.customer.select(_name("customer-", "c_custkey"), _name("nation-", "c_nationkey")))


def _derived(t: Tables) -> DataFrame:
    number = F.col("conv_id") * 10000 + F.col("turn")
    before = t.conversations.select((number + 1).alias("source")).distinct()
    return t.conversations.select(number.alias("source"), (number - 1).alias("target"), "turn").where("turn > 0").join(before, "source", "left_semi").select("source", "target")


def _episodes(t: Tables) -> DataFrame:
    outcome = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure").otherwise("partial")
    return t.events.select("event_id", _name("user-", "user_id").alias("actor"), F.col("ts").alias("started"), outcome.alias("outcome"), F.col("value").alias("cost_usd"))


def _items(t: Tables) -> DataFrame:
    status = F.when(F.col("l.doc_id").isNull(), "draft").when(F.col("toxic") == 1, "retired").otherwise("stable")
    titled = t.documents.withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))  # before the join, where only titles then go if only they are asked for
    labels = F.broadcast(t.labels) if t.labels.count() <= SENT else t.labels  # else all texts are shuffled to them
    joined = titled.alias("d").join(labels.alias("l"), F.col("d.doc_id") == F.col("l.doc_id"), "left")
    return joined.select(_name("doc-", "d.doc_id").alias("slug"), F.col("d.doc_id").alias("k"), F.col("text").alias("body"), "lang", F.col("source").alias("cluster"), "title", status.alias("status"))


def _links(t: Tables) -> DataFrame:
    def typed(df: DataFrame, key: str) -> DataFrame:
        return df.select(_name("part-", "source").alias("source"), F.lit(key).alias("key"), _name("part-", "target").alias("target"))

    lost = t.part.where("p_size = 1").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") + 100000).alias("target"))
    return typed(t.v_requires, "requires").union(typed(t.v_supersedes, "supersedes")).union(typed(t.v_uses, "uses")).union(typed(lost, "related"))


def _triples(t: Tables) -> DataFrame:
    def triples(df: DataFrame, s, p: str, o) -> DataFrame:
        return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))

    c, n, r = _name("customer-", "c_custkey"), _name("nation-", "n_nationkey"), _name("region-", "r_regionkey")
    parts = [
        triples(t.customer, c, "rdf:type", F.lit("Customer")), triples(t.customer, c, "inNation", _name("nation-", "c_nationkey")), triples(t.nation, n, "rdf:type", F.lit("Nation")),
        triples(t.nation, n, "inRegion", _name("region-", "n_regionkey")), triples(t.region, r, "rdf:type", F.lit("Region")), triples(t.nation, n, "label", F.col("n_name")), triples(t.customer, c, "segment", F.col("c_mktsegment")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
