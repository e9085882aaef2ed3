"""Hash-chained ledgers, boards and spending."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

# A task's states, and those in which nothing more happens.
TASK_STATES = ("TASK_STATE_SUBMITTED", "TASK_STATE_WORKING", "TASK_STATE_INPUT_REQUIRED", "TASK_STATE_AUTH_REQUIRED", "TASK_STATE_COMPLETED", "TASK_STATE_CANCELED", "TASK_STATE_FAILED", "TASK_STATE_REJECTED", "TASK_STATE_UNSPECIFIED")
TERMINAL = ("TASK_STATE_COMPLETED", "TASK_STATE_CANCELED", "TASK_STATE_FAILED", "TASK_STATE_REJECTED")

# States in which a task waits for a person.
WAITING = ("TASK_STATE_AUTH_REQUIRED", "TASK_STATE_INPUT_REQUIRED")

# Words of other trackers for states, without blanks, hyphens, colons and apostrophes.
STATE_WORDS = {
    "TASK_STATE_UNSPECIFIED": ("backlog", "icebox", "triage", "unspecified", "none"),
    "TASK_STATE_SUBMITTED": ("todo", "open", "opened", "new", "ready", "selectedfordevelopment", "submitted", "notstarted", "planned", "unstarted", "next", "reopened"),
    "TASK_STATE_WORKING": ("inprogress", "doing", "started", "working", "inreview", "review", "codereview", "active", "wip", "intesting", "testing"),
    "TASK_STATE_INPUT_REQUIRED": ("blocked", "waiting", "onhold", "needsinfo", "inputrequired", "pending", "waitingforinput"),
    "TASK_STATE_AUTH_REQUIRED": ("authrequired", "approval", "awaitingapproval", "needsapproval", "pendingapproval"),
    "TASK_STATE_COMPLETED": ("done", "closed", "resolved", "complete", "completed", "shipped", "released", "fixed", "closedcompleted"),
    "TASK_STATE_FAILED": ("failed", "failure"),
    "TASK_STATE_CANCELED": ("canceled", "cancelled", "wontdo", "wontfix", "duplicate", "notplanned", "closednotplanned", "obsolete", "abandoned"),
    "TASK_STATE_REJECTED": ("rejected", "declined", "invalid"),
}


GENESIS = "0" * 64


def _folded(entries: DataFrame, ledger: str, order: list[str], columns: list[str], step, schema: str) -> DataFrame:
    """What step gives for each entry of a ledger and the hash before it, as (values, hash).

    A ledger is a chain, so its entries pass one task in order, as a stream that holds one hash; ledgers are independent of each other.
    """

    def scan(batches):
        last, seq, prev = None, 0, GENESIS
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if seq == 0 or row[ledger] != last:
                    last, seq, prev = row[ledger], 0, GENESIS
                values, after = step(row, prev)
                out.append({ledger: row[ledger], "seq": seq, **values, "prev": prev, "hash": after})
                seq, prev = seq + 1, after
            yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(kind))

    kind = StructType.fromDDL(schema)
    kind = StructType([entries.schema[ledger], *kind.fields])
    sorted_ = entries.select(ledger, *[c for c in order if c != ledger], *[c for c in columns if c not in order and c != ledger]).repartition(ledger).sortWithinPartitions(ledger, *order)
    return sorted_.mapInArrow(scan, kind)


def chain(entries: DataFrame, ledger: str, order: list[str], body: str) -> DataFrame:
    """(ledger, seq, body, prev, hash): each entry's hash is the SHA-256 of the one before and its body."""

    def step(row: dict, prev: str) -> tuple[dict, str]:
        return {"body": row[body]}, hashlib.sha256((prev + row[body]).encode()).hexdigest()

    return _folded(entries, ledger, order, [body], step, "seq int, body string, prev string, hash string")


def derive(commits: DataFrame, ledger: str, order: list[str]) -> DataFrame:
    """(ledger, seq, entry, prev, hash) of commits in order: entry is canonical JSON of actor, kind, ref, ts, prev and, for the automatic lane, mode; its hash is the SHA-256 of prev and of that.

    commits has ref, ts, actor, n_parents, tag, and trailers, a map. A tag makes a release, two parents or a Proposal trailer a merge, and a
    Channel-Auto trailer the mode; names of trailers are compared without case.
    """

    def step(row: dict, prev: str) -> tuple[dict, str]:
        names = {k.lower() for k, _ in row["trailers"] or ()}
        kind = "release" if row["tag"] else "merge" if (row["n_parents"] or 0) >= 2 or "proposal" in names else "commit"
        entry = {"actor": row["actor"], "kind": kind, "prev": prev, "ref": row["ref"], "ts": row["ts"]} | ({"mode": "auto"} if "channel-auto" in names else {})
        text = json.dumps(entry, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return {"entry": text}, hashlib.sha256((prev + text).encode()).hexdigest()

    return _folded(commits, ledger, order, ["ref", "ts", "actor", "n_parents", "tag", "trailers"], step, "seq int, entry string, prev string, hash string")


def trailers(c: Column) -> Column:
    """A map of a commit message's trailers: the Key: value lines of its last paragraph, if it has nothing else; lines that begin with a blank go on, and the last of a key counts."""
    last = F.element_at(F.split(F.regexp_replace(c, r"\s+$", ""), r"\n[ \t]*\n"), -1)
    joined = F.regexp_replace(F.regexp_replace(last, r"^\n+", ""), r"[ \t]*\n[ \t]+", " ")
    lines = F.split(joined, "\n")
    pair = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([^:]*):", 1)).alias("low"), F.regexp_extract(x, r"^([^:]*):", 1).alias("key"), F.regexp_replace(F.regexp_extract(x, r"^[^:]*:(.*)$", 1), r"^\s+|\s+$", "").alias("value")))
    latest = F.filter(pair, lambda x, i: ~F.exists(F.slice(pair, i + 2, F.size(pair)), lambda y: y["low"] == x["low"]))
    fits = F.forall(lines, lambda x: x.rlike(r"^[A-Za-z0-9][A-Za-z0-9-]*:[ \t]"))
    none = F.create_map().cast("map<string,string>")
    return F.when(fits, F.map_from_entries(F.transform(latest, lambda x: F.struct(x["key"], x["value"])))).otherwise(none)


def verify(chained: DataFrame, ledger: str) -> DataFrame:
    """(ledger, seq, reason) of entries whose hash doesn't follow from their body, or whose prev isn't the hash before."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(ledger).orderBy("seq")), F.repeat(F.lit("0"), 64))
    reason = F.when(F.col("prev") != before, "prev").when(F.col("hash") != F.sha2(F.concat("prev", "body"), 256), "hash")
    return chained.withColumn("reason", reason).where("reason is not null").select(ledger, "seq", "reason")


def board(tasks: DataFrame) -> DataFrame:
    """(cluster, n_tasks, n_open, done) of tasks (cluster, slug, state)."""
    open_ = ~F.col("state").isin(*TERMINAL)
    return tasks.groupBy("cluster").agg(F.count("*").alias("n_tasks"), F.sum(open_.cast("long")).alias("n_open"), F.bool_and(~open_).alias("done"))


def over_limit(tasks: DataFrame, limit: int) -> DataFrame:
    """(claimant, n_working) of claimants with more tasks in work than the limit."""
    return tasks.where("state = 'TASK_STATE_WORKING'").groupBy("claimant").agg(F.count("*").alias("n_working")).where(F.col("n_working") > limit)


def waiting(tasks: DataFrame) -> DataFrame:
    """Tasks that wait for a person."""
    return tasks.where(F.col("state").isin(*WAITING))


def merged_boards(boards: dict[str, DataFrame]) -> DataFrame:
    """(origin, slug, iri, state, blocked_by) of several nodes' tasks (slug, state, blocked_by): none is renamed, and blockers are the IRIs of their own node."""
    out = None
    for origin, tasks in boards.items():
        base = F.lit(origin.rstrip("/") + "/")
        own = tasks.select(F.lit(origin).alias("origin"), "slug", F.concat(base, "slug").alias("iri"), "state", F.transform("blocked_by", lambda slug: F.concat(base, slug)).alias("blocked_by"))  # noqa: B023
        out = own if out is None else out.unionByName(own)
    return out


def merges_by_lane(lanes: DataFrame, entries: DataFrame) -> DataFrame:
    """(lane, merges) of every lane; entries has actor and kind."""
    merges = entries.where("kind = 'merge'").groupBy(F.col("actor").alias("lane")).agg(F.count("*").alias("merges"))
    return lanes.join(merges, "lane", "left").select("lane", F.coalesce("merges", F.lit(0)).alias("merges"))


def content_version(steps: DataFrame, within: str, order: str, tag: str) -> DataFrame:
    """steps with version: the nearest tag before a step and how many steps it is away; 0 before any."""
    before = Window.partitionBy(within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last_value(F.when(F.col(tag).isNotNull(), F.struct(F.col(tag).alias("t"), F.col(order).alias("o"))), F.lit(True)).over(before)
    return steps.withColumn("__last", last).withColumn("version", F.coalesce(F.concat(F.lit("v"), F.col("__last.t").cast("string"), F.lit("+"), (F.col(order) - F.col("__last.o")).cast("string")), F.lit("0"))).drop("__last")


def unchecked_merges(entries: DataFrame, ledger: str, order: list[str], broken: Column) -> DataFrame:
    """Entries after a ledger's first for which a condition holds."""
    first = Window.partitionBy(ledger).orderBy(*order)
    return entries.withColumn("__n", F.row_number().over(first)).where((F.col("__n") > 1) & broken).drop("__n")


def spend(episodes: DataFrame, by: list[str]) -> DataFrame:
    """Episodes and their exact cost in a month and whatever else is named."""
    month = F.date_format("started", "yyyy-MM").alias("month")
    return episodes.groupBy(month, *by).agg(F.count("*").alias("n_episodes"), F.sum(F.col("cost_usd").cast("decimal(28,6)")).cast("decimal(38,6)").alias("spent"))


def state_of(word: str) -> Column:
    """The state that a tracker's word stands for; unspecified for words that aren't known."""
    plain = F.regexp_replace(F.lower(F.col(word)), r"[\s\-_:'’]+", "")
    by_word = {w: state for state, words in STATE_WORDS.items() for w in words}
    words = F.create_map(*[F.lit(x) for pair in by_word.items() for x in pair])
    return F.coalesce(F.try_element_at(words, plain), F.lit("TASK_STATE_UNSPECIFIED"))


def claimants(log: DataFrame, tasks: DataFrame) -> DataFrame:
    """(slug, claimant): the author of the last commit that has a task's file; none if that commit names no author.

    log has (at, file, author), a row for each file of a commit, at in the order of commits; tasks has (slug, path). A file is a task's if it is its path or ends with /
    and its path. Files meet paths by equality on all their tails at slashes, never each with each. Of tasks with one path the greatest slug has it.
    """
    parts = F.split("file", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
    own = tasks.where("path is not null").groupBy("path").agg(F.max("slug").alias("slug"))
    met = log.where("file is not null").select("at", "author", F.explode(tails).alias("path")).join(own, "path")
    last = met.groupBy("slug").agg(F.max_by(F.coalesce("author", F.lit("")), "at").alias("claimant"))
    return last.where("claimant != ''")
