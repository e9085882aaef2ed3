from lattix.operators import ledger
from lattix.streaming import meters


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def stream(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def test_claims_are_held_across_batches(spark, tmp_path):
    s = stream(spark, tmp_path, [[("t", "a", "claim", 1), ("t", "b", "claim", 2), ("t", "a", "release", 3), ("t", "b", "claim", 4), ("u", "b", "release", 1)]], "task string, actor string, action string, seq long")
    assert [(r.task, r.actor, r.granted) for r in sorted(drain(meters.claims(s), "claims"), key=lambda r: r.task)] == [("t", "a", True), ("t", "b", False), ("t", "a", True), ("t", "b", True), ("u", "b", False)]


def test_ledger_stream_equals_batch(spark, tmp_path):
    rows = [("l", i, f"b{i}") for i in range(6)] + [("m", 0, "x")]
    s = stream(spark, tmp_path, [rows], "ledger string, seq long, body string")
    want = {(r.ledger, r.hash) for r in ledger.chain(spark.createDataFrame(rows, "ledger string, seq long, body string"), "ledger", ["seq"], "body").collect()}
    assert {(r.ledger, r.hash) for r in drain(meters.ledger_stream(s), "ledgers")} == want


def test_spend_meter_and_sessions(spark, tmp_path):
    rows = [("2026-01-01T00:00:00Z", "a", 3.0), ("2026-01-02T00:00:00Z", "a", 4.0), ("2026-01-02T00:00:00Z", "b", 1.0)]
    df = spark.createDataFrame(rows, "started string, actor string, cost_usd double").selectExpr("timestamp(started) started", "actor", "cost_usd")
    df.write.parquet(str(tmp_path / "p"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "p"))
    got = {(r.month, r.actor): (r.n_episodes, r.spent, r.reached) for r in drain(meters.spend_meter(live, 5), "spend", "update")}
    assert got == {("2026-01", "a"): (2, 7.0, True), ("2026-01", "b"): (1, 1.0, False)}
    capped = {(r.month, r.actor): (r.n_episodes, r.spent, r.reached) for r in drain(meters.spend_meter(live, 2), "capped", "update")}
    assert capped == {("2026-01", "a"): (1, 3.0, True), ("2026-01", "b"): (1, 1.0, False)}
    events = df.selectExpr("started ts", "actor user_id")
    events.write.parquet(str(tmp_path / "e"))
    runs = drain(meters.sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))), "runs", "complete")
    assert sorted((r.user_id, r.n_events) for r in runs) == [("a", 1), ("a", 1), ("b", 1)]
