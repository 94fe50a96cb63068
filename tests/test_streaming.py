from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.streaming import posts, runs

SCHEMA = T.StructType([T.StructField("post_id", T.LongType()), T.StructField("channel", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("value", T.DoubleType())])


def write(spark, path, *batches):
    for batch in batches:
        rows = [(i, c, t, v) for i, c, t, v in batch]
        spark.createDataFrame(rows, "post_id long, channel string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)


def test_dedup_and_slots(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [(1, "a", "2026-01-01 00:10:00", 1.0), (1, "a", "2026-01-01 00:10:00", 1.0), (2, "a", "2026-01-01 05:00:00", 2.0)], [(1, "a", "2026-01-01 00:20:00", 1.0), (3, "b", "2026-01-02 00:00:00", 4.0)])
    once = posts.deduplicated(posts.read_posts(spark, path, SCHEMA), ["channel", "post_id"])
    got = posts.drain(once, "dedup_out", str(tmp_path / "c1"))
    assert sorted(r.post_id for r in got.collect()) == [1, 2, 3]
    slots = posts.slot_counts(posts.read_posts(spark, path, SCHEMA))
    closed = {str(r.slot_start): r.n for r in posts.drain(slots, "slot_out", str(tmp_path / "c2")).collect()}
    assert closed == {"2026-01-01 00:00:00": 3, "2026-01-01 04:00:00": 1}


def test_repeats_attach(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [(1, "a", "2026-01-01 00:00:00", 0.0), (2, "a", "2026-01-01 01:00:00", 0.0)], [(3, "a", "2026-01-02 00:00:00", 0.0), (4, "b", "2026-01-02 00:00:00", 0.0)], [(5, "a", "2026-01-09 00:00:00", 0.0)])
    out = posts.attach_repeats(posts.read_posts(spark, path, SCHEMA), "channel", "post_id")
    got = {r.post_id: (r.event, r.action) for r in posts.drain(out, "attach_out", str(tmp_path / "c")).collect()}
    assert got == {1: (1, "emit"), 2: (1, "attach"), 3: (1, "attach"), 4: (4, "emit"), 5: (5, "emit")}


def test_written_once(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, path, [(1, "a", "2026-01-01 00:00:00", 0.0)], [(1, "a", "2026-01-01 00:00:00", 0.0), (2, "a", "2026-01-01 00:00:00", 0.0)])
    posts.write_once(posts.read_posts(spark, path, SCHEMA), out, str(tmp_path / "c"), ["post_id"]).awaitTermination()
    assert sorted(r.post_id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_written_once_within_the_horizon(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, path, [(1, "a", "2026-01-01 00:00:00", 0.0), (2, "a", "2026-01-01 00:00:00", 0.0)])
    write(spark, path, [(1, "a", "2026-01-03 00:00:00", 0.0)])
    write(spark, path, [(1, "a", "2026-01-20 00:00:00", 0.0), (3, "a", "2026-01-20 00:00:00", 0.0)])

    def run():
        posts.write_once(posts.read_posts(spark, path, SCHEMA), out, str(tmp_path / "c"), ["post_id"], "ts", 3).awaitTermination()
        return sorted((r.post_id, r.batch) for r in spark.read.parquet(out).select("post_id", "batch").collect())

    first = run()
    assert [i for i, _ in first] == [1, 1, 2, 3]  # the third batch comes after the horizon
    assert run() == first  # a restart adds nothing
    write(spark, path, [(3, "a", "2026-01-21 00:00:00", 0.0), (4, "a", "2026-01-21 00:00:00", 0.0)])
    assert [i for i, _ in run()] == [1, 1, 2, 3, 4]
    days = spark.read.parquet(f"{out}_sent").where("day >= '2026-01-17'")
    assert "PartitionFilters: [isnotnull(day" in days._jdf.queryExecution().executedPlan().toString()


def test_since_the_last_successful_run(spark):
    when = F.to_timestamp(F.lit("2026-01-01"))
    rows = spark.createDataFrame([(i, f"2026-01-0{i}") for i in range(1, 7)], "post int, d string").withColumn("at", F.to_timestamp("d"))
    log = spark.createDataFrame([(1, "2026-01-02", "ok"), (2, "2026-01-04", "ok"), (3, "2026-01-05", "failed")], "run int, d string, status string").withColumn("started", F.to_timestamp("d"))
    assert sorted(r.post for r in runs.since_last_success(rows, log, "at", when).collect()) == [5, 6]
    assert sorted(r.post for r in runs.since_last_success(rows, log.where("run = 3"), "at", when).collect()) == [2, 3, 4, 5, 6]


def test_fresh_entries(spark):
    now = F.to_timestamp(F.lit("2026-01-08 12:00:00"))
    cache = spark.createDataFrame([("a", "2026-01-01 12:00:00", 1), ("b", "2026-01-01 12:00:01", 2), ("c", "2025-01-01 00:00:00", 3), ("c", "2026-01-08 00:00:00", 4)], "k string, t string, v int").withColumn("at", F.to_timestamp("t")).select("k", "at", "v")
    assert sorted((r.k, r.v) for r in runs.fresh_entries(cache, "k", "at", now, 7).collect()) == [("b", 2), ("c", 4)]


def test_one_writer_at_a_time(spark, tmp_path):
    path = str(tmp_path / "lock")
    with runs.single_writer(spark, path) as mine:
        assert mine
        with runs.single_writer(spark, path) as other:
            assert not other
        with runs.single_writer(spark, path, ttl_seconds=-1) as later:
            assert later  # the lock is stale for this one
        assert not (tmp_path / "lock").exists()
    with runs.single_writer(spark, path) as again:
        assert again
    assert not (tmp_path / "lock").exists()
