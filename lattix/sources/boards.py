"""Readers of other trackers' exports. Each gives the same columns:

id, title, body, word (the tracker's state), state, assignee, labels, board, due, created, updated, blocked_by, format.
Dates are yyyy-MM-dd text; what a format lacks is null, or an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattix.functions.text import csv_unguarded
from lattix.operators.ledger import state_of

COLUMNS = ("id", "title", "body", "word", "state", "assignee", "labels", "board", "due", "created", "updated", "blocked_by", "format")
FORMATS = ("dd/MMM/yy h:mm a", "dd/MMM/yy", "MMMM d, yyyy h:mm a", "MMMM d, yyyy", "dd/MM/yyyy", "MM/dd/yyyy")


def date_of(c: Column) -> Column:
    """The day of a date in ISO form or in one of FORMATS; else null."""
    text = F.trim(c)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(text, F.lit(10)))
    return F.coalesce(iso, *[F.date_format(F.try_to_timestamp(text, F.lit(f)), "yyyy-MM-dd") for f in FORMATS])


def words_of(c: Column, separators: str = ",") -> Column:
    """Trimmed, non-empty parts of a list in text."""
    return F.coalesce(F.filter(F.transform(F.split(c, f"[{separators}]"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def rows(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    none = {"labels": F.array().cast("array<string>"), "blocked_by": F.array().cast("array<string>")}
    text = lambda c: F.when(F.trim(c) != "", c)
    found = {c: columns.get(c, none.get(c, F.lit(None).cast("string"))) for c in COLUMNS}
    picked = df.select(*[(v if c in none else text(v.cast("string")) if c in columns else v).alias(c) for c, v in found.items() if c not in ("state", "format")])
    return picked.withColumn("state", state_of("word")).withColumn("format", F.lit(kind)).select(*COLUMNS)


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV file with quoted line ends; a byte-order mark and formula guards are taken off. Repeated headers get Spark's numbers."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', sep=sep)
    clean = lambda c: csv_unguarded(F.regexp_replace(F.col(f"`{c}`"), "^﻿", ""))
    return df.select(*[clean(c).alias(c.lstrip("﻿").strip()) for c in df.columns])


def column(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that is there, else null; case doesn't count."""
    have = {c.lower(): c for c in df.columns}
    return next((F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have), F.lit(None).cast("string"))


def repeated(df: DataFrame, name: str) -> Column:
    """An array of what columns of one repeated header hold."""
    own = [F.col(f"`{c}`") for c in df.columns if c.rstrip("0123456789").lower() == name.lower()]
    return F.filter(F.array(*own), lambda x: F.trim(x) != "") if own else F.array().cast("array<string>")


def jira(spark: SparkSession, path: str) -> DataFrame:
    d = read_table(spark, path)
    return rows(d, "jira", id=column(d, "Issue key"), title=column(d, "Summary"), body=column(d, "Description"), word=column(d, "Status"), assignee=column(d, "Assignee"), labels=repeated(d, "Labels"), board=column(d, "Project name"), due=date_of(column(d, "Due date")), created=date_of(column(d, "Created")), updated=date_of(column(d, "Updated")), blocked_by=words_of(column(d, "Inward issue link (Blocks)")))


def linear(spark: SparkSession, path: str) -> DataFrame:
    d = read_table(spark, path)
    return rows(d, "linear", id=column(d, "ID"), title=column(d, "Title"), body=column(d, "Description"), word=column(d, "Status"), assignee=column(d, "Assignee"), labels=words_of(column(d, "Labels")), board=column(d, "Project"), due=date_of(column(d, "Due Date")), created=date_of(column(d, "Created")), updated=date_of(column(d, "Updated")))


def asana(spark: SparkSession, path: str) -> DataFrame:
    d = read_table(spark, path)
    word = F.when(F.trim(column(d, "Completed At")) != "", "done").otherwise(column(d, "Section/Column"))
    return rows(d, "asana", id=column(d, "Task ID"), title=column(d, "Name"), body=column(d, "Notes"), word=word, assignee=column(d, "Assignee"), labels=words_of(column(d, "Tags")), board=column(d, "Projects"), due=date_of(column(d, "Due Date")), created=date_of(column(d, "Created At")), updated=date_of(column(d, "Last Modified")), blocked_by=words_of(column(d, "Blocked By (Dependencies)")))


def notion(spark: SparkSession, path: str) -> DataFrame:
    d = read_table(spark, path)
    return rows(d, "notion", id=column(d, "Name", "Title", "Task"), title=column(d, "Name", "Title", "Task"), word=F.when(F.lower(column(d, "Status")) == "not started", "to do").otherwise(column(d, "Status")), assignee=column(d, "Assignee", "Owner", "Person"), labels=words_of(column(d, "Tags", "Labels")), due=date_of(column(d, "Due", "Due date", "Deadline")), created=date_of(column(d, "Created time", "Created")), updated=date_of(column(d, "Last edited time", "Updated")))


def gitlab(spark: SparkSession, path: str) -> DataFrame:
    """Closed wins, then a status:: or workflow:: label, then opened."""
    d = read_table(spark, path)
    labels = words_of(column(d, "Labels"))
    scoped = F.regexp_extract(F.array_join(labels, "\n"), r"(?:status|workflow)::([^\n]+)", 1)
    word = F.when(F.lower(column(d, "State")) == "closed", "closed").when(scoped != "", scoped).otherwise("open")
    return rows(d, "gitlab", id=column(d, "Issue ID"), title=column(d, "Title"), body=column(d, "Description"), word=word, assignee=column(d, "Assignee Username"), labels=labels, board=column(d, "Milestone"), due=date_of(column(d, "Due Date")), created=date_of(column(d, "Created At (UTC)")), updated=date_of(column(d, "Updated At (UTC)")))


GITHUB = "number long, title string, body string, state string, state_reason string, labels array<struct<name: string>>, assignee struct<login: string>, assignees array<struct<login: string>>, milestone struct<title: string>, created_at string, updated_at string, pull_request string"


def github(spark: SparkSession, path: str) -> DataFrame:
    """Issues; pull requests are left out. A reason refines closed."""
    d = spark.read.schema(GITHUB).json(path, multiLine=True).where("pull_request is null")
    word = F.when(F.col("state") == "closed", F.when(F.col("state_reason") == "not_planned", "not planned").otherwise("closed")).otherwise("open")
    who = F.coalesce(F.col("assignee.login"), F.try_element_at(F.col("assignees.login"), F.lit(1)))
    return rows(d, "github", id=F.col("number"), title=F.col("title"), body=F.col("body"), word=word, assignee=who, labels=F.coalesce(F.col("labels.name"), F.array().cast("array<string>")), board=F.col("milestone.title"), created=date_of(F.col("created_at")), updated=date_of(F.col("updated_at")))


TRELLO = "name string, lists array<struct<id: string, name: string>>, members array<struct<id: string, username: string>>, cards array<struct<shortLink: string, name: string, `desc`: string, idList: string, idMembers: array<string>, labels: array<struct<name: string>>, due: string, dueComplete: boolean, closed: boolean, dateLastActivity: string>>"


def trello(spark: SparkSession, path: str) -> DataFrame:
    """Cards with their list as state; a card whose due date is met is done."""
    board = spark.read.schema(TRELLO).json(path, multiLine=True)
    cards = board.select(F.col("name").alias("board"), "lists", "members", F.explode("cards").alias("c"))
    list_ = F.try_element_at(F.expr("filter(lists, x -> x.id = c.idList)"), F.lit(1))
    who = F.try_element_at(F.expr("filter(members, m -> m.id = try_element_at(c.idMembers, 1))"), F.lit(1))
    labels = F.expr("filter(transform(c.labels, x -> x.name), x -> x != '')")
    return rows(cards, "trello", id=F.col("c.shortLink"), title=F.col("c.name"), body=F.col("c.desc"), word=F.when(F.col("c.dueComplete"), "done").otherwise(list_["name"]), assignee=who["username"], labels=F.coalesce(labels, F.array().cast("array<string>")), board=F.col("board"), due=date_of(F.col("c.due")), updated=date_of(F.col("c.dateLastActivity")))


def todotxt(spark: SparkSession, path: str) -> DataFrame:
    """x marks what is done; then a priority, one or two dates, and words, of which +project, @context and key:value are taken out."""
    d = spark.read.text(path).where(F.trim("value") != "").withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    done = F.col("value").rlike(r"^x ")
    rest = F.regexp_replace("value", r"^x ", "")
    rest = F.regexp_replace(rest, r"^\([A-Z]\) ", "")
    first, second = F.regexp_extract(rest, r"^(\d{4}-\d{2}-\d{2}) ", 1), F.regexp_extract(rest, r"^\d{4}-\d{2}-\d{2} (\d{4}-\d{2}-\d{2}) ", 1)
    text = F.regexp_replace(rest, r"^(?:\d{4}-\d{2}-\d{2} ){1,2}", "")
    words = F.split(text, r"\s+")
    title = F.array_join(F.filter(words, lambda w: ~w.rlike(r"^[+@]\S|^[A-Za-z]+:[^/\s]\S*$")), " ")
    tags = F.transform(F.filter(words, lambda w: w.rlike(r"^@\S")), lambda w: F.regexp_replace(w, "^@", ""))
    project = F.regexp_extract(text, r"(?:^|\s)\+(\S+)", 1)
    value = lambda k: F.regexp_extract(text, rf"(?:^|\s){k}:(\S+)", 1)
    word = F.when(done, "done").otherwise(F.when(value("state") != "", value("state")).otherwise("todo"))
    return rows(d, "todotxt", id=title, title=title, word=word, labels=tags, board=project, due=date_of(value("due")), created=date_of(F.when(done, second).otherwise(first)), updated=date_of(F.when(done, first)))


def markdown(spark: SparkSession, path: str, lanes: bool = False) -> DataFrame:
    """Checkbox lines under headings: the heading of level 2 is the state unless the box is checked, indented lines after a card are its body.

    lanes leaves out what follows a line of three stars, which is the archive of a kanban board. Lines of one file are put in order together; files are independent.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("lines"))
    lines = whole.select("file", F.posexplode("lines").alias("n", "line"))
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.sum(F.col("line").rlike(r"^\s{0,3}(?:```|~~~)").cast("int")).over(before) % 2 == 1
    last = lambda pattern: F.last_value(F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1)), F.lit(True)).over(before)
    card = r"^[-*+] \[[ xX]\] "
    marked = lines.withColumn("fenced", fence).where("not fenced").withColumn("lane", last(r"^##\s+(.+?)\s*$")).withColumn("top", last(r"^#\s+(.+?)\s*$"))
    marked = marked.withColumn("archived", F.max(F.col("line").rlike(r"^\*\*\*\s*$")).over(before))
    marked = marked.withColumn("card", F.last_value(F.when(F.col("line").rlike(card), F.col("n")).when(~F.col("line").rlike(r"^\s+\S"), F.lit(-1)), F.lit(True)).over(before))
    if lanes:
        marked = marked.where("not archived")
    found = marked.where("card >= 0").groupBy("file", "card").agg(F.max(F.when(F.col("n") == F.col("card"), F.struct("line", "lane", "top"))).alias("c"), F.array_sort(F.collect_list(F.when(F.col("n") > F.col("card"), F.struct("n", F.trim("line").alias("t"))))).alias("rest"))
    text = F.regexp_replace("c.line", card, "")
    parts = F.split(text, "<br>")
    plain = F.trim(F.regexp_replace(parts[0], r"(?:^|\s)(?:[#@][^\s{]+|@\{[^}]*\}|[A-Za-z]+:\d{4}-\d{2}-\d{2})", ""))
    due = F.coalesce(F.nullif(F.regexp_extract(text, r"@\{(\d{4}-\d{2}-\d{2})\}", 1), F.lit("")), F.regexp_extract(text, r"due:(\d{4}-\d{2}-\d{2})", 1))
    word = F.when(F.col("c.line").rlike(r"^[-*+] \[[xX]\]"), "done").otherwise(F.coalesce("c.lane", F.lit("todo")))
    body = F.array_join(F.concat(F.slice(parts, F.lit(2), F.size(parts)), F.col("rest.t")), "\n")
    return rows(found, "kanban" if lanes else "markdown", id=plain, title=plain, body=body, word=word, assignee=F.regexp_extract(text, r"(?:^|\s)@([^\s{]+)", 1), labels=F.regexp_extract_all(text, F.lit(r"(?:^|\s)#(\S+)"), 1), board=F.col("c.top"), due=date_of(due))


READERS = {"jira": jira, "linear": linear, "asana": asana, "notion": notion, "gitlab": gitlab, "github": github, "trello": trello, "todotxt": todotxt, "markdown": markdown, "kanban": lambda s, p: markdown(s, p, lanes=True)}


def read_board(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return READERS[kind](spark, path)
