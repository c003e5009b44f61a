import datetime as dt

from feuillet.operators import metrics, sync
from feuillet.streaming.sync_stream import searches_per_window, watch_catalogue


def test_watch_catalogue(spark, tmp_path):
    schema = "relative_path string, content_hash string, modified_at string"
    old = spark.createDataFrame([("a", "1", "1"), ("b", "1", "1")], schema)
    spark.createDataFrame([("a", "2", "2"), ("c", "1", "1"), ("b", "1", "1")], schema).write.parquet(str(tmp_path / "in"))
    seen = []
    q = watch_catalogue(spark, str(tmp_path / "in"), old.schema, lambda: old, lambda batch, changes, epoch: seen.extend(map(tuple, changes.collect())), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(seen) == [("a", "updated"), ("c", "added")]


def test_windows(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10, 0, 0)
    rows = [(1, at, 0), (1, at, 0), (2, at + dt.timedelta(minutes=3), 4), (3, at + dt.timedelta(hours=5), 1)]
    spark.createDataFrame(rows, "history_id long, received_at timestamp, results_count int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("history_id long, received_at timestamp, results_count int").parquet(str(tmp_path / "in"))
    q = searches_per_window(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.searches, r.no_result) for r in spark.table("w").collect()) == [(1, 0), (2, 1)]


def test_percentile_and_rates(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "value double")
    row = metrics.latency_summary(df).first()
    assert (row.avg_ms, row.p95_ms, row.p99_ms, row.samples) == (5.5, 10.0, 10.0, 10)
    empty = metrics.latency_summary(df.limit(0)).first()
    assert (empty.avg_ms, empty.p95_ms, empty.samples) == (0.0, 0.0, 0)


def test_upsert_keeps_identity(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, relative_path string, content_hash string")
    new = spark.createDataFrame([(9, "a", "z"), (10, "c", "w")], "id long, relative_path string, content_hash string")
    got = {r.relative_path: (r.id, r.content_hash) for r in sync.upsert(old, new).collect()}
    assert got == {"a": (1, "z"), "b": (2, "y"), "c": (10, "w")}
