"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from weftline.streaming import ops


def run(spark, tmp_path, rows, schema, build, mode="append"):
    """Writes the rows as files, runs the stream over them file by file, returns what came out."""
    source = str(tmp_path / "in")
    for k, part in enumerate([rows[: len(rows) // 2], rows[len(rows) // 2 :]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    name = f"out_{tmp_path.name}".replace("-", "_")
    query = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_sessions_join_at_the_gap(spark, tmp_path):
    rows = [("a", 0), ("a", 10), ("a", 19), ("a", 40), ("b", 5)]
    schema = "key string, sec int"
    got = run(spark, tmp_path, rows, schema, lambda s: ops.sessions(s.withColumn("ts", F.timestamp_seconds("sec")), "key", "ts", "10 seconds", "1 hour"), "complete")
    assert sorted((k, a.timestamp(), b.timestamp(), n) for k, a, b, n in got) == [("a", 0.0, 19.0, 3), ("a", 40.0, 40.0, 1), ("b", 5.0, 5.0, 1)]


def test_change_gate(spark, tmp_path):
    rows = [("k", 1, 0, False), ("k", 2, 1, False), ("k", 3, 7, False), ("k", 4, 7, True), ("k", 5, 7, False)]
    got = run(spark, tmp_path, rows, "key string, t long, hash long, cut boolean", lambda s: ops.change_gate(s, "key", 3))
    assert sorted(got) == [("k", 1, 0), ("k", 3, 7), ("k", 4, 7)]


def test_rate_limit_window_starts_with_the_first_hit(spark, tmp_path):
    rows = [("u", t) for t in (5, 6, 7, 64, 65, 66)]
    got = run(spark, tmp_path, rows, "key string, t long", lambda s: ops.rate_limit(s, "key", 2, 60))
    assert sorted(got) == [("u", 5, True), ("u", 6, True), ("u", 7, False), ("u", 64, False), ("u", 65, True), ("u", 66, True)]


def test_throttle_and_cuts(spark, tmp_path):
    rows = [("u", 0, 1.0), ("u", 3, 2.0), ("u", 5, 1.0), ("u", 6, 3.0), ("u", 12, 4.0)]
    got = run(spark, tmp_path, rows, "key string, t long, value double", lambda s: ops.throttle(s, "key", 5))
    assert sorted(got) == [("u", 0, 1.0), ("u", 6, 3.0), ("u", 12, 4.0)]


def test_leases(spark, tmp_path):
    rows = [(1, 0, "claim", "a"), (1, 10, "claim", "b"), (1, 20, "heartbeat", "a"), (1, 60, "claim", "b"), (1, 61, "heartbeat", "a"), (1, 62, "complete", "b"), (1, 200, "claim", "c")]
    got = run(spark, tmp_path, rows, "job long, t long, action string, token string", lambda s: ops.leases(s, "job", 30))
    assert [ok for _, _, _, ok in sorted(got)] == [True, False, True, True, False, True, False]


def test_rows_of_one_key_are_folded_in_order(spark, tmp_path):
    """30,000 hits of one key in one micro-batch, the latest first: more than one Arrow frame."""
    hits = spark.range(30_000).selectExpr("'u' as key", "29999 - id as t").coalesce(1)
    hits.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "in"))
    query = ops.rate_limit(stream, "key", 5, 100).writeStream.format("memory").queryName("many_hits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.table("many_hits").where("allowed").count() == 1500
    assert spark.table("many_hits").where("t % 100 < 5 and not allowed").count() == 0


def test_tumbling_windows(spark, tmp_path):
    rows = [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", 3, 8.0)]
    got = run(spark, tmp_path, rows, "key string, sec int, value double", lambda s: ops.tumbling(s.withColumn("ts", F.timestamp_seconds("sec")), ["key"], "ts", "2 seconds", "1 hour", "value"), "complete")
    assert sorted((k, a.timestamp(), n, v) for k, a, n, v in got) == [("a", 0.0, 2, 3.0), ("a", 2.0, 1, 4.0), ("b", 2.0, 1, 8.0)]
