import json

from lattix.operators import links
from lattix.sources import boards, markdown, memories


def put(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_csv_boards(spark, tmp_path):
    jira = put(tmp_path, "j.csv", 'Summary,Issue key,Status,Project name,Assignee,Created,Due date,Labels,Labels,Description,Inward issue link (Blocks)\nPaint,P-1,In Progress,Home,kai,03/Feb/26 4:05 PM,,a,b,"one\ntwo","P-2, P-3"\n\'=1+1,P-2,Done,Home,,04/Feb/26 9:00 AM,05/Feb/26,,,,\n')
    got = by_id(boards.read_board(spark, jira, "jira"))
    assert (got["P-1"].state, got["P-1"].labels, got["P-1"].blocked_by, got["P-1"].created, got["P-1"].body) == ("TASK_STATE_WORKING", ["a", "b"], ["P-2", "P-3"], "2026-02-03", "one\ntwo")
    assert (got["P-2"].title, got["P-2"].state, got["P-2"].due, got["P-2"].labels) == ("=1+1", "TASK_STATE_COMPLETED", "2026-02-05", [])
    linear = put(tmp_path, "l.csv", 'ID,Title,Description,Status,Project,Assignee,Labels,Created,Updated,Due Date\nL-1,T,,Canceled,Q,bo,"x, y",2026-01-02T00:00:00.000Z,,\n')
    row = by_id(boards.read_board(spark, linear, "linear"))["L-1"]
    assert (row.state, row.labels, row.created, row.due, row.body) == ("TASK_STATE_CANCELED", ["x", "y"], "2026-01-02", None, None)
    asana = put(tmp_path, "a.csv", "Task ID,Created At,Completed At,Last Modified,Name,Section/Column,Assignee,Due Date,Tags,Notes,Projects,Blocked By (Dependencies)\n1,2026-06-01,2026-06-02,,N,To do,,,,,M,2\n2,2026-06-01,,,O,Waiting,,,,,M,\n")
    got = by_id(boards.read_board(spark, asana, "asana"))
    assert (got["1"].state, got["1"].blocked_by, got["2"].state) == ("TASK_STATE_COMPLETED", ["2"], "TASK_STATE_INPUT_REQUIRED")
    notion = put(tmp_path, "n.csv", '﻿Name,Status,Tags,Due\nSketch,Not started,"d, w","March 4, 2026"\n')
    row = by_id(boards.read_board(spark, notion, "notion"))["Sketch"]
    assert (row.state, row.due, row.labels) == ("TASK_STATE_SUBMITTED", "2026-03-04", ["d", "w"])
    gitlab = put(tmp_path, "g.csv", 'Issue ID,Title,State,Description,Assignee Username,Due Date,Created At (UTC),Updated At (UTC),Milestone,Labels\n7,T,Open,,d,,2026-02-20 10:00:00,,R,"ui, status::Blocked"\n8,U,Closed,,,,,,R,status::Doing\n')
    got = by_id(boards.read_board(spark, gitlab, "gitlab"))
    assert (got["7"].state, got["7"].created, got["8"].state) == ("TASK_STATE_INPUT_REQUIRED", "2026-02-20", "TASK_STATE_COMPLETED")


def test_json_boards(spark, tmp_path):
    issues = [{"number": 1, "title": "a", "state": "closed", "state_reason": "not_planned", "labels": [{"name": "l"}], "assignees": [{"login": "q"}], "created_at": "2026-01-02T09:00:00Z"}, {"number": 2, "title": "pr", "state": "open", "pull_request": {"url": "u"}}]
    got = by_id(boards.read_board(spark, put(tmp_path, "i.json", json.dumps(issues)), "github"))
    assert set(got) == {"1"} and (got["1"].state, got["1"].assignee, got["1"].labels) == ("TASK_STATE_CANCELED", "q", ["l"])
    board = {"name": "B", "lists": [{"id": "1", "name": "Doing"}], "members": [{"id": "m", "username": "u"}], "cards": [{"shortLink": "s", "name": "c", "desc": "", "idList": "1", "idMembers": ["m"], "labels": [{"name": ""}, {"name": "x"}], "due": "2026-04-01T12:00:00.000Z"}, {"shortLink": "t", "name": "d", "idList": "9", "idMembers": [], "labels": [], "dueComplete": True}]}
    got = by_id(boards.read_board(spark, put(tmp_path, "t.json", json.dumps(board)), "trello"))
    assert (got["s"].state, got["s"].assignee, got["s"].labels, got["s"].due, got["s"].board) == ("TASK_STATE_WORKING", "u", ["x"], "2026-04-01", "B") and got["t"].state == "TASK_STATE_COMPLETED"


def test_line_boards(spark, tmp_path):
    todo = put(tmp_path, "todo.txt", "(B) 2026-09-01 Ring the shop +Home @phone due:2026-09-05\nx 2026-09-03 2026-09-01 Buy ink +Work\n\nSee http://x/y state:waiting\n")
    got = by_id(boards.read_board(spark, todo, "todotxt"))
    assert (got["Ring the shop"].due, got["Ring the shop"].labels, got["Ring the shop"].board, got["Ring the shop"].created) == ("2026-09-05", ["phone"], "Home", "2026-09-01")
    assert (got["Buy ink"].state, got["Buy ink"].updated, got["Buy ink"].created) == ("TASK_STATE_COMPLETED", "2026-09-03", "2026-09-01") and got["See http://x/y"].state == "TASK_STATE_INPUT_REQUIRED"
    md = put(tmp_path, "b.md", "# Site\n\n- [ ] Write it @lee #text due:2026-08-01\n  Short.\n- [x] Old\n- plain\n  not a body\n```\n- [ ] fenced\n```\n## Blocked\n- [ ] Logo\n")
    got = by_id(boards.read_board(spark, md, "markdown"))
    assert set(got) == {"Write it", "Old", "Logo"} and (got["Write it"].assignee, got["Write it"].labels, got["Write it"].due, got["Write it"].body, got["Write it"].board) == ("lee", ["text"], "2026-08-01", "Short.", "Site")
    assert (got["Old"].state, got["Logo"].state) == ("TASK_STATE_COMPLETED", "TASK_STATE_INPUT_REQUIRED")
    kanban = put(tmp_path, "k.md", "## Doing\n\n- [ ] Act @{2026-07-01}<br>More\n\n***\n\n## Archive\n\n- [x] Gone\n")
    got = by_id(boards.read_board(spark, kanban, "kanban"))
    assert set(got) == {"Act"} and (got["Act"].due, got["Act"].body, got["Act"].state) == ("2026-07-01", "More", "TASK_STATE_WORKING")


def test_memories(spark, tmp_path):
    page = {"results": [{"id": "1", "memory": "Likes tea\nand cake", "categories": ["taste"], "createdAt": "2026-08-01T10:00:00Z"}, {"id": "2", "messages": [{"content": "a"}, {"content": "b"}], "created_at": "2026-08-02"}, {"id": "3", "memory": "  "}]}
    got = by_id(memories.read_memories(spark, put(tmp_path, "m.json", json.dumps(page)), "mem0"))
    assert set(got) == {"1", "2"} and (got["1"].title, got["1"].tags, got["1"].day, got["2"].text) == ("Likes tea", ["taste"], "2026-08-01", "a\nb")
    assert set(by_id(memories.read_memories(spark, put(tmp_path, "m2.json", json.dumps(page["results"])), "mem0"))) == {"1", "2"}
    letta = put(tmp_path, "l.json", json.dumps([{"id": "p", "text": "x", "tags": None, "embedding": [0.5]}, {"id": "q", "text": " "}]))
    assert [(r.id, r.tags) for r in memories.read_memories(spark, letta, "letta").collect()] == [("p", [])]
    zep = put(tmp_path, "z.json", json.dumps({"items": [{"uuid": "e", "content": "said"}, {"uuid": "n", "name": "Node", "summary": "sum"}]}))
    assert {(r.id, r.title, r.text) for r in memories.read_memories(spark, zep, "zep").collect()} == {("e", "said", "said"), ("n", "Node", "sum")}
    notes = put(tmp_path, "n.csv", 'Title,Body,Tags,Date\nKeys,"l1\nl2",a; b,2026-05-01\n,,,\nOnly,,,bad\n')
    assert {(r.title, r.text, tuple(r.tags), r.day) for r in memories.read_memories(spark, notes, "csv").collect()} == {("Keys", "l1\nl2", ("a", "b"), "2026-05-01"), ("Only", "Only", (), None)}


def test_markdown_items_and_links(spark, tmp_path):
    put(tmp_path, "c/one.md", '---\ntype: concept\ntitle: "One thing"\ntags:\n  - a\n  - "b c"\nuses: [two, three]\nrequires:\n- four\n---\nSee [x](../c/two.md) and [[Five|5]] and ![i](pic.png)\n```\n[no](code.md)\n```\n[ext](http://e/f)\n')
    put(tmp_path, "c/two.md", "no front matter")
    put(tmp_path, "c/three.md", "---\ntitle: &a Bad\n---\nBody\n")
    items = markdown.read_items(spark, f"file://{tmp_path}/c")
    got = {r.slug: r for r in items.collect()}
    assert (got["one"].title, got["one"].type, got["one"].tags) == ("One thing", "concept", ["a", "b c"]) and (got["two"].finding, got["three"].finding) == ("no-frontmatter", "refused-construct")
    edges = markdown.authored_links(items)
    assert {(r.source, r.key, r.target) for r in edges.collect()} == {("one", "uses", "two"), ("one", "uses", "three"), ("one", "requires", "four")}
    assert {r.target for r in links.dangling(edges, items).collect()} == {"four"}
    assert {r.target for r in markdown.mentions(items).collect()} == {"two", "Five"}


def test_sinks(spark, tmp_path):
    df = spark.range(1200).selectExpr("format_string('s%05d', id) slug", "id v").repartition(5)
    markdown.write_sharded(df, "slug", f"file://{tmp_path}/shards")
    back = spark.read.json(f"file://{tmp_path}/shards")
    assert {(r.shard, r.n, r.low) for r in back.groupBy("shard").agg({"slug": "min", "v": "count"}).withColumnsRenamed({"min(slug)": "low", "count(v)": "n"}).collect()} == {(0, 500, "s00000"), (1, 500, "s00500"), (2, 200, "s01000")}
    markdown.write_lines(df.union(df), "slug", f"file://{tmp_path}/lines")
    assert spark.read.text(f"file://{tmp_path}/lines").count() == 1200
