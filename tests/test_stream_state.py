"""State of streams that ends: timers by event time, and the store's own time to live."""

import os
import time
from datetime import datetime

from pagesift.streaming import state


def stepped(spark, tmp_path, batches, make, mode="update"):
    """Runs a stream once for each batch of rows (k, t) and gives what each micro-batch told."""
    os.makedirs(f"{tmp_path}/in")
    told = []
    source = spark.readStream.schema("k string, t timestamp").parquet(f"{tmp_path}/in")
    for rows in batches:
        spark.createDataFrame([(k, datetime.fromisoformat(f"2024-01-{t}")) for k, t in rows], "k string, t timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        make(source).writeStream.foreachBatch(lambda df, n: told.extend((n, r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return told


def test_a_bucket_ends_and_comes_back(spark, tmp_path):
    batches = [
        [("a", "01 00:00:00"), ("a", "01 00:00:01"), ("a", "01 00:00:01"), ("b", "01 00:30:00")], [("b", "01 02:00:00")],
        [("a", "01 03:00:00"), ("c", "01 05:00:00")], [("a", "01 02:00:00")],
    ]
    told = stepped(spark, tmp_path, batches, lambda s: state.bucket_states(s, "k", "t", 0.5, 2.0, "10 minutes", "1 hour"))
    of = lambda k: [(r.events, r.refused, r.level, r.ended) for _, r in told if r.k == k]
    assert of("a") == [(3, 1, 1.5, False), (3, 1, 0.0, True), (1, 0, 1.0, False), (1, 0, 0.0, True)]  # ended, back at nothing, ended; the last came too late
    assert of("b") == [(1, 0, 1.0, False), (2, 0, 1.0, False), (2, 0, 0.0, True)]
    assert of("c") == [(1, 0, 1.0, False)]


def test_a_run_goes_on_while_events_come(spark, tmp_path):
    batches = [[("view", "01 00:00:00")], [("view", "01 20:00:00")], [("click", "02 15:00:00")], [("view", "04 00:00:00")]]
    told = stepped(spark, tmp_path, batches, lambda s: state.running_state(s.selectExpr("'run' AS run", "k", "t"), "run", "k", "t", idle="1 day"))
    assert [(r.events, r.pages, r.ended) for _, r in told] == [(1, 1, False), (2, 2, False), (3, 2, False), (4, 3, False)]


def test_seen_keys_pass_again_when_forgotten(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    put = lambda *keys: spark.createDataFrame([(k, 1) for k in keys], "k string, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    told = []
    stream = state.once_within(spark.readStream.schema("k string, n int").parquet(f"{tmp_path}/in"), ["k"], "8 seconds")
    query = stream.writeStream.foreachBatch(lambda df, n: told.extend(r.k for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()

    def waited(n):
        until = time.time() + 40
        while len(told) < n and time.time() < until:
            time.sleep(0.2)
        return sorted(told)

    try:
        put("a", "a", "b")
        assert waited(2) == ["a", "b"]
        time.sleep(10)
        put("a")
        assert waited(3) == ["a", "a", "b"]
    finally:
        query.stop()
