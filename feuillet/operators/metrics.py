"""Search metrics from a log, and the summaries of benchmarks and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feuillet.plans.numbering import number_rows


def last_samples(log: DataFrame, n: int = 200, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The n latest rows: a sort with a limit, which each task cuts first."""
    return log.orderBy(*(F.desc(c) for c in order)).limit(n)


def nearest_rank(values: Column, percent: float) -> Column:
    """Element at round-half-even(p/100 x (n - 1)) of the sorted values; for a bounded array such as the last samples."""
    n = F.size(values)
    place = F.greatest(F.lit(0), F.least(n - 1, F.bround(F.lit(percent / 100) * (n - 1), 0).cast("int")))
    return F.when(n > 0, F.element_at(F.sort_array(values), place + 1)).otherwise(0.0)


def latency_summary(samples: DataFrame, value: str = "value") -> DataFrame:
    """avg, p95, p99 (two decimals) and the number of a bounded set of samples."""
    got = samples.agg(F.collect_list(value).alias("v"), F.avg(value).alias("a"))
    return got.select(F.round(F.coalesce("a", F.lit(0.0)), 2).alias("avg_ms"), F.round(nearest_rank(F.col("v"), 95), 2).alias("p95_ms"), F.round(nearest_rank(F.col("v"), 99), 2).alias("p99_ms"), F.size("v").cast("long").alias("samples"))


def search_counters(history: DataFrame) -> DataFrame:
    """total, errors (no count of results), no_result, error_rate over the history, each row once."""
    own = history.dropDuplicates(["history_id"])
    return own.agg(F.count("*").alias("total"), F.count_if(F.col("results_count").isNull()).alias("errors"), F.count_if(F.col("results_count") == 0).alias("no_result")).withColumn("error_rate", F.round(F.coalesce(F.col("errors") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 6))


def cache_replay(history: DataFrame, ttl_s: int = 300) -> DataFrame:
    """hits, misses, hit rate and untimed (searches without a readable time, in neither) that a cache with this time to live
    would have had. A miss stores an entry, which lives `ttl_s` from then on; a hit doesn't renew it. The cache is taken as
    large enough for its keys (the 128 entries of the driver's cache only bound its memory).

    Searches of a key are combined by time slots of `ttl_s` first. Between slots with an empty one in the middle no entry
    lives on, so only runs of busy slots are gone through in order.
    """
    own = history.dropDuplicates(["history_id"])
    ttl = ttl_s * 1_000_000
    timed = own.where("ts is not null").select("key", F.unix_micros("ts").alias("t")).withColumn("slot", F.floor(F.col("t") / ttl))
    slots = timed.groupBy("key", "slot").agg(F.count("*").alias("n"), F.collect_set("t").alias("times"))
    order = Window.partitionBy("key").orderBy("slot")
    fresh = F.coalesce(F.col("slot") - F.lag("slot").over(order) > 1, F.lit(True)).cast("int")
    runs = slots.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order)).groupBy("key", "run").agg(F.sum("n").alias("n"), F.array_sort(F.flatten(F.collect_list("times"))).alias("times"))
    start = F.struct(F.lit(None).cast("long").alias("put"), F.lit(0).cast("long").alias("misses"))
    step = lambda acc, t: F.when(acc["put"].isNull() | (t - acc["put"] >= ttl), F.struct(t.alias("put"), (acc["misses"] + 1).alias("misses"))).otherwise(acc)
    missed = runs.select("n", F.aggregate("times", start, step)["misses"].alias("misses")).agg(F.coalesce(F.sum("misses"), F.lit(0)).alias("misses"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    untimed = own.agg(F.count_if(F.col("ts").isNull()).alias("untimed"))
    rate = F.round((F.col("total") - F.col("misses")) / F.nullif(F.col("total"), F.lit(0)) * 100, 1)
    return missed.crossJoin(untimed).select((F.col("total") - F.col("misses")).alias("hits"), "misses", rate.alias("hit_rate_pct"), "untimed")  # one row each


def sync_counters(syncs: DataFrame) -> DataFrame:
    """total, errors, average duration (two decimals) and the latest of the synchronisations (at, mode, documents_indexed,
    duration_ms, error), with the number of documents of the latest that went well."""
    latest = F.max(F.struct("at", "mode", "documents_indexed", "duration_ms", "error"))
    good = F.max(F.when(F.col("error").isNull(), F.struct("at", "documents_indexed")))
    got = syncs.agg(F.count("*").alias("sync_total"), F.count("error").alias("sync_errors"), F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 2).alias("sync_avg_ms"), latest.alias("l"), good.alias("g"))
    return got.select("sync_total", "sync_errors", "sync_avg_ms", F.col("l.mode").alias("last_mode"), F.col("l.at").alias("last_at"), F.coalesce("g.documents_indexed", F.lit(0)).alias("documents_indexed"))


def snapshot(history: DataFrame, latencies: DataFrame, syncs: DataFrame, value: str = "value") -> DataFrame:
    """The whole state in one row: search counters, latencies of the last samples, synchronisations."""
    return search_counters(history).crossJoin(latency_summary(last_samples(latencies), value)).crossJoin(sync_counters(syncs))  # one row each


def over_rate(log: DataFrame, limit: int = 5, window: str = "1 minute", by: str = "user_id", at: str = "ts") -> DataFrame:
    """Tumbling windows in which a caller made more than `limit` calls."""
    return log.groupBy(by, F.window(at, window).alias("w")).agg(F.count("*").alias("calls")).where(F.col("calls") > limit).select(by, F.col("w.start").alias("window_start"), "calls")


def benchmark_summary(times: DataFrame, value: str = "value", by: str = "event_type") -> DataFrame:
    """Mean, median and the elements at int(0.95 n) and int(0.99 n) of the sorted times of each group. The rows are numbered in
    a global order, range by range, so a large group is sorted by many tasks; then the wanted numbers are picked."""
    ranked = number_rows(times.select(by, value), [by, value], "place")
    groups = ranked.groupBy(by).agg(F.min("place").alias("first"), F.count("*").alias("n"), F.avg(value).alias("mean"))
    r, n = F.col("place") - F.col("first"), F.col("n")
    pick = lambda p: F.least(n - 1, F.floor(n * p).cast("long"))
    low, high = F.floor((n - 1) / 2), F.floor(n / 2)
    wanted = ranked.join(groups, by).where((r == low) | (r == high) | (r == pick(0.95)) | (r == pick(0.99)))
    at = lambda c: F.max(F.when(c, F.col(value)))
    got = wanted.groupBy(by).agg(F.first("mean").alias("mean"), F.avg(F.when((r == low) | (r == high), F.col(value))).alias("median"), at(r == pick(0.95)).alias("p95"), at(r == pick(0.99)).alias("p99"))
    return got.select(by, F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "p95", "p99")


def benchmark_report(queries: DataFrame) -> DataFrame:
    """The lines of a benchmark file, in order: metrics of all searches (avg, median, p95, p99, total) as metric and value, then a
    line for each query (query, results_count, latency_ms, best_score) with its values joined by commas. A benchmark is a
    short list of queries, so it is one sorted array."""
    v = F.col("v")
    size = F.size(v)
    at = lambda p: F.element_at(v, F.least(size - 1, F.floor(size * p).cast("int")) + 1)
    middle = (F.element_at(v, F.floor((size - 1) / 2).cast("int") + 1) + F.element_at(v, F.floor(size / 2).cast("int") + 1)) / 2
    got = queries.agg(F.array_sort(F.collect_list("latency_ms")).alias("v"), F.avg("latency_ms").alias("a"), F.sum("latency_ms").alias("t")).where(F.size("v") > 0)
    figures = (("avg_latency_ms", F.col("a")), ("median_latency_ms", middle), ("p95_latency_ms", at(0.95)), ("p99_latency_ms", at(0.99)), ("total_latency_ms", F.col("t")))
    metrics = got.select(F.explode(F.array(*(F.struct(F.lit(k).alias("line_no"), F.lit(name).alias("name"), F.format_string("%.2f", c).alias("text")) for k, (name, c) in enumerate(figures)))).alias("x")).select("x.*")
    text = F.concat_ws(",", F.coalesce(F.col("results_count").cast("string"), F.lit("")), F.format_string("%.2f", "latency_ms"), F.format_string("%.4f", F.coalesce("best_score", F.lit(0.0))))
    lines = queries.select((F.col("qid") + len(figures)).cast("int").alias("line_no"), F.col("query").alias("name"), text.alias("text"))
    return metrics.unionByName(lines)


def top1_accuracy(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of queries whose first result is the expected path; queries without a result count as wrong."""
    first = ranked.where("rank = 1").select("qid", "relative_path")
    return expected.join(first, "qid", "left").agg(F.count("*").alias("n"), F.count_if(F.col("relative_path") == F.col("expected_path")).alias("right")).withColumn("accuracy", F.round(F.col("right") / F.nullif(F.col("n"), F.lit(0)), 6))


def grade(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """qid, grade: PASS if the first result has the category or name looked for, PARTIAL if one of the first five has, else FAIL."""
    rows = expected.join(ranked.where("rank <= 5"), "qid", "left")
    fits = F.coalesce(F.contains(F.lower("category"), F.lower("expected_cat")) | F.contains(F.lower("file_name"), F.lower("expected_name")), F.lit(False))
    got = rows.groupBy("qid").agg(F.coalesce(F.bool_or(fits & (F.col("rank") == 1)), F.lit(False)).alias("first"), F.bool_or(fits).alias("any"))
    return got.select("qid", F.when(F.col("first"), "PASS").when(F.col("any"), "PARTIAL").otherwise("FAIL").alias("grade"))


def grade_category(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """qid, grade by the first result alone: PASS if its category or name holds the category looked for, PARTIAL if there is
    a result at all, else FAIL."""
    rows = expected.join(ranked.where("rank = 1"), "qid", "left")
    fits = F.contains(F.lower("category"), F.lower("expected_cat")) | F.contains(F.lower("file_name"), F.lower("expected_cat"))
    return rows.select("qid", F.when(F.coalesce(fits, F.lit(False)), "PASS").when(F.col("rank").isNotNull(), "PARTIAL").otherwise("FAIL").alias("grade"))


def pass_rate(graded: DataFrame, by: str) -> DataFrame:
    return graded.groupBy(by).agg(F.count("*").alias("n"), F.round(100 * F.avg((F.col("grade") == "PASS").cast("int")), 4).alias("pass_pct"))
