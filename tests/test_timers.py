"""Streams with timers and tables: over several micro-batches, with silent keys and replayed batches."""

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from weftline.operators import folds
from weftline.sources.readers import parse_progress
from weftline.streaming import progress, timers

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def run(spark, tmp_path, parts, schema, build):
    """Runs the stream over the parts, a micro-batch each."""
    source = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    name = f"out_{tmp_path.name}".replace("-", "_")
    query = build(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return [tuple(r) for r in spark.table(name).collect()]


BASE = 1_700_000_000


def second(s):
    return datetime.fromtimestamp(BASE + s, timezone.utc)


def test_tracks_of_a_stream_are_those_of_the_table(rocks, tmp_path):
    rnd = random.Random(3)
    rows, n = [], 0
    for t in range(60):
        for key in (1, 2):
            for _ in range(rnd.randint(0, 4)):
                rows.append((key, second(t), n, float(rnd.randint(0, 60)), float(rnd.randint(0, 40)), 20.0, 15.0))
                n += 1
    schema = "key int, ts timestamp, id long, x double, y double, w double, h double"
    parts = [[r for r in rows if a <= r[1].timestamp() - BASE < a + 15] for a in range(0, 60, 15)]
    for part in parts:
        rnd.shuffle(part)
    parts.append([(9, second(1000), n, 0.0, 0.0, 1.0, 1.0)])  # another key's row, which lets the watermark pass
    got = run(rocks, tmp_path, parts, schema, lambda s: timers.track_boxes(s, ["key"], "ts", "0 seconds", 100_000))
    batch = folds.track_boxes(rocks.createDataFrame(rows, schema).withColumn("t", F.col("ts").cast("long")), ["key"])
    assert sorted(r[:4] for r in got if not r[4] and r[0] != 9) == sorted(tuple(r) for r in batch.select("key", "id", "track", "hits").collect())
    tracks = {}
    for key, _, track, hits, _ in got:
        tracks[key, track] = max(hits, tracks.get((key, track), 0))
    ended = [(r[0], r[2], r[3]) for r in got if r[4]]
    assert sorted(ended) == sorted((k, n, h) for (k, n), h in tracks.items() if k != 9)  # each track ends once, the last ones by a timer


def test_a_lease_ends_without_another_row(rocks, tmp_path):
    schema = "job long, ts timestamp, action string, token string"
    first = [(1, second(0), "claim", "a"), (1, second(10), "claim", "b"), (2, second(5), "claim", "c"), (3, second(5), "claim", "d"), (3, second(20), "heartbeat", "x")]
    then = [(1, second(25), "heartbeat", "a"), (2, second(30), "complete", "c"), (2, second(31), "claim", "e")]
    last = [(9, second(500), "claim", "z")]  # only this job has rows now
    late = [(3, second(510), "heartbeat", "d"), (1, second(520), "claim", "f"), (1, second(521), "heartbeat", "a")]
    got = run(rocks, tmp_path, [first, then, last, late], schema, lambda s: timers.leases(s, "job", "ts", "0 seconds", 60_000))
    assert sorted((j, t // 1000 - BASE, a, k, ok) for j, t, a, k, ok in got) == sorted(
        [
            (1, 0, "claim", "a", True), (1, 10, "claim", "b", False), (1, 25, "heartbeat", "a", True), (1, 85, "expired", "a", True), (1, 520, "claim", "f", True), (1, 521, "heartbeat", "a", False),
            (2, 5, "claim", "c", True), (2, 30, "complete", "c", True), (2, 31, "claim", "e", False),
            (3, 5, "claim", "d", True), (3, 20, "heartbeat", "x", False), (3, 65, "expired", "d", True), (3, 510, "heartbeat", "d", True),
            (9, 500, "claim", "z", True),
        ]
    )


def line(job, elapsed, sampled, total=100):
    numbers = dict.fromkeys(["percent", "observations", "scene_cuts", "ocr_calls", "roi_candidates", "samples_per_sec", "frames_per_sec", "video_speed_x"], 1.0)
    event = {"type": "ocr_progress", "targeted": True, "sampled": sampled, "total_samples": total, "elapsed_sec": elapsed, **numbers}
    return job, f"log [ocr-events-progress] {json.dumps(event)}"


def test_progress_table_survives_a_replay(spark, tmp_path):
    parts = [[line(1, 0.0, 0), line(1, 10.0, 20), line(2, 5.0, 50), (1, "noise")], [line(1, 20.0, 60), line(3, 1.0, 1)], [line(1, 20.0, 60), line(1, 30.0, 100), line(2, 5.0, 50)]]
    source, folder = str(tmp_path / "in"), str(tmp_path / "table")
    for part in parts:
        spark.createDataFrame(part, "job long, value string").coalesce(1).write.mode("append").parquet(source)
    stream = parse_progress(spark.readStream.schema("job long, value string").option("maxFilesPerTrigger", 1).parquet(source), keys=("job",))
    assert progress.write_progress(stream, folder, str(tmp_path / "c"), availableNow=True).awaitTermination(240)
    rows = lambda: sorted(tuple(r) for r in progress.current(spark, folder).select("job", "elapsed", "sampled", "percent", "rate", "remaining", "events").collect())
    want = [(1, 30.0, 100.0, 100.0, 4.0, 0.0, 5), (2, 5.0, 50.0, 50.0, None, None, 2), (3, 1.0, 1.0, 1.0, None, None, 1)]
    assert rows() == want
    assert progress.snapshots(spark, folder) == [0, 1, 2]
    for number in (1, 2, 2):  # batches that run again change nothing
        events = parse_progress(spark.createDataFrame(parts[number], "job long, value string"), keys=("job",))
        progress.apply_batch(events, number, folder)
        assert rows() == want
    middle = progress.current(spark, folder, before=2).where("job = 1").first()
    assert (middle.rate, middle.remaining) == (4.0, 10.0)


def test_progress_of_odd_events(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert progress.current(spark, folder).count() == 0
    events = parse_progress(spark.createDataFrame([line(1, None, 5, 0), line(1, 3.0, 6, 0)], "job long, value string"), keys=("job",))
    progress.apply_batch(events, 0, folder)
    row = progress.current(spark, folder).first()
    assert (row.elapsed, row.percent, row.rate, row.events) == (3.0, None, None, 2)
    progress.apply_batch(events.limit(0), 1, folder)
    assert progress.current(spark, folder).first() == row
