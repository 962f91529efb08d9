"""Sources, sinks, streams and trajectories."""

import datetime as dt

from pyspark.sql import functions as F

from hopwright.operators import graphs, latents, sequences
from hopwright.sources import corpus
from hopwright.streaming import sessions


def test_feed_round_trip_and_manifest(spark, tmp_path):
    root = str(tmp_path / "c")
    df = spark.createDataFrame([("vl.app", "2026-01-05T09:00:00.000Z", "a", "m", 0), ("vl.app", "2026-01-05T09:00:01.000Z", "b", None, 1)], "kind string, ts string, log_id string, message string, shard int")
    corpus.write_feed(df, root)
    (tmp_path / "c/raw/shard=0/.x").touch()
    (tmp_path / "c/raw/shard=0/state.jsonl.gz").write_bytes(b"")
    (tmp_path / "c/raw/shard=0/0.done").write_text("x")
    got = corpus.read_feed(spark, root)
    assert sorted((r.log_id, r.message, r["shard"]) for r in got.collect()) == [("a", "m", 0), ("b", None, 1)]
    assert corpus.completed_shards(spark, root) == ["0"]
    first = corpus.manifest(spark, root)
    rows = spark.createDataFrame(first.collect(), first.schema)
    assert corpus.manifest_problems(rows, corpus.manifest(spark, root)).count() == 0
    (tmp_path / "c/raw/shard=0/0.done").write_text("y")
    (tmp_path / "c/new.txt").write_text("n")
    found = {r.path.split("/")[-1]: r.problem for r in corpus.manifest_problems(rows, corpus.manifest(spark, root)).collect()}
    assert found == {"0.done": "changed", "new.txt": "unlisted"}


def test_views_are_partitioned(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") < 80, "train").otherwise("test").alias("split"), F.lit("2026-01-05").alias("date"))
    corpus.write_views(df, str(tmp_path / "v"))
    assert (tmp_path / "v/split=train/date=2026-01-05").is_dir()
    assert corpus.read_columns(spark, str(tmp_path / "v"), ["id"]).count() == 100


def test_readable_paths(spark):
    df = spark.createDataFrame([("raw/a",), ("oracle/a",), ("views/../oracle/a",), ("metrics/x",)], "p string")
    assert [r[0] for r in df.select(corpus.is_readable(F.col("p"))).collect()] == [True, False, False, True]
    assert corpus.evenly_spaced(list(range(100)), 5) == [0, 25, 50, 74, 99]


def test_content_hash_ignores_order(spark):
    df = spark.range(50).withColumn("x", F.col("id") % 7)
    assert corpus.content_hash(df).first() == corpus.content_hash(df.orderBy(F.desc("id"))).first() != corpus.content_hash(df.union(df)).first()


def test_stream_sessions_equal_batch_runs(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 5, 9)
    at = [0, 30 * 60, 60 * 60 + 1, 10_000, 20_000]
    rows = [(u, t0 + dt.timedelta(seconds=s + 7 * u)) for u in (1, 2) for s in at]
    df = spark.createDataFrame(rows, "u int, ts timestamp")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(9, t0 + dt.timedelta(days=9))], "u int, ts timestamp")
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sessions.run_to_table(sessions.stream_sessions(stream, ["u"]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = sorted((r.u, r.start, r.end, r.n) for r in spark.read.parquet(str(tmp_path / "out")).filter("u < 9").collect())
    batch = sequences.with_runs(df.withColumn("ms", F.unix_millis("ts")), ["u"], "ms", "ts").groupBy("u", "run").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
    assert got == sorted((r.u, r.a, r.b, r.n) for r in batch.collect())


def test_stream_sessions_end_just_beyond_the_gap(spark, tmp_path):
    t0, gap = dt.datetime(2026, 1, 5, 9), dt.timedelta(minutes=30)
    at = lambda micros=0: t0 + gap + dt.timedelta(microseconds=micros)
    # User 9 sets the watermark; the second file's record of user 4 comes just at the gap, late by the whole margin.
    first = spark.createDataFrame([(1, t0), (1, at()), (2, t0), (2, at(1000)), (3, t0), (3, at(1)), (4, t0), (9, at(5_000_000))], "u int, ts timestamp")
    first.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
    run = lambda: sessions.run_to_table(sessions.stream_sessions(stream, ["u"]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    run()
    spark.createDataFrame([(4, at())], first.schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    sessions.close_source(first, str(tmp_path / "in"))
    run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {u: sorted(r.n for r in got if r.u == u) for u in (1, 2, 3, 4)} == {1: [2], 2: [1, 1], 3: [1, 1], 4: [2]}


def test_the_end_of_a_source_closes_its_sessions(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 5, 9)
    df = spark.createDataFrame([(1, t0), (2, t0 + dt.timedelta(minutes=40))], "u int, ts timestamp")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    run = lambda: sessions.run_to_table(sessions.stream_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["u"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    run().awaitTermination(120)
    sessions.close_source(df, str(tmp_path / "in"))
    query = run()
    query.awaitTermination(120)
    assert sorted(r.u for r in spark.read.schema("u int").parquet(str(tmp_path / "out")).collect()) == [1, 2] and sessions.dropped_rows(query) == 0
    whole = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    sessions.run_complete_groups(whole, ["u"], str(tmp_path / "groups"), str(tmp_path / "ck2")).awaitTermination(120)
    assert sorted(r.u for r in spark.read.parquet(str(tmp_path / "groups")).filter("u is not null").collect()) == [1, 2]


def test_floors_and_their_cycles(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.5), ("c", "a", 0.1)], "src string, dst string, s double")
    got = {r.floor: (r.edges, r.nodes, r.acyclic) for r in graphs.floor_sensitivity(edges, [0.05, 0.3, 0.95], "src", "dst", "s").collect()}
    assert got == {0.05: (3, 3, False), 0.3: (2, 3, True), 0.95: (0, 0, True)}


def test_trajectories(spark):
    services = spark.createDataFrame([(0, [0, 1]), (1, [2])], "service int, endpoints array<int>")
    level = latents.intensity_of([1.0] * 24, __import__("numpy").arange(400))
    run = lambda s, forced=(): {(r.tick, r.variable, r.slot): r.value for r in latents.trajectories(spark, s, 0, 400, level, 3, forced=forced).collect()}
    a, b = run(services), run(services.repartition(3))
    assert a == b and len(a) == 400 * (2 * 3 + 3)
    faults = spark.createDataFrame([("crash", 2, 100.4, 120.2)], "kind string, slot int, start_s double, end_s double")
    c = run(services, latents.forcings(faults))
    assert all(c[t, latents.HEALTH, 2] == 2 for t in range(100, 121))
    # Draws are keyed, so all other variables are as they were.
    assert all(c[k] == a[k] for k in a if k[1:] != (latents.HEALTH, 2))
    load = [v for (t, var, s), v in a.items() if var == latents.LOAD]
    assert set(load) == {0, 1, 2} and load.count(0) > load.count(2) / 2
