"""Queries of draws, states, mechanism, sources and sinks over the driver tables, with the same question in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopwright.functions import draws as D
from hopwright.functions import spans as S
from hopwright.operators import mechanism, projection, report, scoring, sequences, simulate
from hopwright.plans.driver_queries import _RUNS, events, table, uniform_sql
from hopwright.sources import corpus, registry
from hopwright.storage import shared_folder
from hopwright.streaming import sessions as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _drawn(spark, sf_dir, domain: int, *more: int) -> DataFrame:
    e = table(spark, sf_dir, "events")
    draw = lambda d: D.uniform(7, d, F.col("event_id"), F.col("user_id"))
    return e.select("event_id", "user_id", "value", draw(domain).alias("u"), *(draw(d).alias(f"u{i}") for i, d in enumerate(more, 1)))


def _sql(domain: int, select: str) -> str:
    return f"{uniform_sql(7, domain)} SELECT u.event_id, {select} FROM u JOIN events e ON e.event_id = u.event_id"


# Draws


_CDF = "list_transform(range(0, 12), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-m) * pow(m, i) / gamma(i + 1))))"


@query(f"{uniform_sql(7, 21)}, x AS (SELECT event_id, u, 2.5::DOUBLE AS m FROM u) SELECT event_id, len(list_filter({_CDF}[1:11], lambda c: u >= c))::INTEGER AS n FROM x")
def poisson_draw(spark, sf_dir):
    return _drawn(spark, sf_dir, 21).select("event_id", D.poisson(F.col("u"), 2.5).alias("n"))


@query(f"{uniform_sql(7, 22)}, x AS (SELECT u.event_id, u, 0.2 + (e.user_id % 5) AS m FROM u JOIN events e USING (event_id)) SELECT event_id, len(list_filter(list_transform(range(0, 40), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-m) * pow(m, i) / gamma(i + 1)))), lambda c: u >= c))::INTEGER AS n FROM x")
def arrival_counts(spark, sf_dir):
    """Arrivals by inversion with a mean of each row's own."""
    return _drawn(spark, sf_dir, 22).select("event_id", simulate.poisson_count(F.col("u"), 0.2 + (F.col("user_id") % 5)).alias("n"))


@query(_sql(23, "round(CASE WHEN u <= 0.5 THEN 0.5 + u * 3 WHEN u <= 0.9 THEN 2 + (u - 0.5) * 7.5 WHEN u <= 0.95 THEN 5 + (u - 0.9) * 60 WHEN u <= 0.99 THEN 8 + (u - 0.95) * 100 ELSE 12 + (u - 0.99) * 1800 END, 6) AS pause"))
def step_pause(spark, sf_dir):
    return _drawn(spark, sf_dir, 23).select("event_id", F.round(D.gap(F.col("u"), [2.0, 5.0, 8.0, 12.0], 30.0), 6).alias("pause"))


@query(f"{uniform_sql(7, 24)}, v AS ({uniform_sql(7, 25)[5:].replace('a0 AS', 'WITH a0 AS', 1)} SELECT event_id, u AS w FROM u) SELECT event_id, round(sqrt(-2 * ln(greatest(u, 1e-12))) * cos(2 * pi() * w), 6) AS z FROM u JOIN v USING (event_id)")
def normal_draw(spark, sf_dir):
    return _drawn(spark, sf_dir, 24, 25).select("event_id", F.round(D.normal(F.col("u"), F.col("u1")), 6).alias("z"))


@query(_sql(26, "[[200, 200, 200, 201, 204], [400, 400, 404, 403, 409], [500, 500, 503, 502, 500], [0, 0, 0, 0, 0], [200, 200, 200, 201, 204]][e.user_id % 5 + 1][floor(u * 5)::INTEGER + 1] AS status"))
def status_draw(spark, sf_dir):
    return _drawn(spark, sf_dir, 26).select("event_id", S.status_of((F.col("user_id") % 5).cast("int"), F.col("u")).alias("status"))


@query(_sql(27, "round(1 - (1 - CASE WHEN value > 50 THEN 0.98 ELSE 0 END) * (1 - CASE WHEN e.user_id % 3 = 0 THEN 0.05 ELSE 0 END), 9) AS chance, u < 1 - (1 - CASE WHEN value > 50 THEN 0.98 ELSE 0 END) * (1 - CASE WHEN e.user_id % 3 = 0 THEN 0.05 ELSE 0 END) AS err"))
def client_errors(spark, sf_dir):
    p = S.client_error_chance(F.col("value") > 50, F.col("user_id") % 3 == 0)
    return _drawn(spark, sf_dir, 27).select("event_id", F.round(p, 9).alias("chance"), (F.col("u") < p).alias("err"))


@query("SELECT event_id, CASE WHEN user_id % 5 IN (0, 2, 4) THEN user_id % 5 ELSE 0 END AS outcome FROM events")
def repertoire_mask(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.within_repertoire(F.col("user_id") % 5, [0, 2, 4]).cast("bigint").alias("outcome"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 1 THEN 3.0 ELSE 1.0 END * CASE WHEN l_suppkey % 3 = 1 THEN 1.5 WHEN l_suppkey % 3 = 2 THEN 4.0 ELSE 1.0 END * CASE WHEN l_returnflag = 'R' THEN 1.25 ELSE 1.0 END AS multiplier FROM lineitem")
def latency_multipliers(spark, sf_dir):
    m = S.latency_multiplier(F.col("l_linenumber") % 3, F.col("l_suppkey") % 3, F.col("l_returnflag") == "R", 3.0, 1.5, 4.0, 1.25)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", m.alias("multiplier"))


@query("SELECT event_id, round(1 - (1 - value / 1000) * (1 - user_id % 7 / 10) * (1 - 0.1), 9) AS p FROM events")
def noisy_or(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(D.noisy_or(F.array(F.col("value") / 1000, F.col("user_id") % 7 / 10, F.lit(0.1))), 9).alias("p"))


@query("SELECT event_id, strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events")
def iso_times(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", S.iso_ms(F.col("ms")).alias("iso"))


_HOURS, _DAYS = [0.2 + 0.05 * h for h in range(24)], [1.0, 1.1, 1.2, 1.3, 1.4, 0.5, 0.4]


@query(f"WITH p AS (SELECT event_id, ({[round(h, 2) for h in _HOURS]}::DOUBLE[])[hour(ts) + 1] * ({_DAYS}::DOUBLE[])[isodow(ts)] AS r FROM events) SELECT event_id, round(r, 9) AS rate, CASE WHEN r < 0.5 THEN 1 WHEN r > 1.15 THEN 2 ELSE 0 END AS intensity FROM p")
def intensity_profile(spark, sf_dir):
    r = S.profile(F.col("ms"), [round(h, 2) for h in _HOURS], _DAYS)
    return events(spark, sf_dir).select("event_id", F.round(r, 9).alias("rate"), simulate.intensity(r).alias("intensity"))


@query(_sql(28, "1 AS one").replace("SELECT u.event_id, 1 AS one FROM u JOIN events e ON e.event_id = u.event_id", "SELECT count(*) AS n, round(avg((u < 0.3)::INTEGER), 9) AS p, round(stddev_samp((u < 0.3)::INTEGER) / sqrt(count(*)), 9) AS se FROM u"))
def sampled_share(spark, sf_dir):
    """An estimate by keyed samples with its standard error."""
    hit = (F.col("u") < 0.3).cast("int")
    return _drawn(spark, sf_dir, 28).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 9).alias("p"), F.round(F.stddev_samp(hit) / F.sqrt(F.count(F.lit(1))), 9).alias("se"))


# Mechanism


@query("SELECT s_suppkey, round(b / (a + b), 9) AS warm FROM (SELECT s_suppkey, 0.01 + (s_suppkey % 50) / 100 AS a, 0.05 + (s_nationkey % 10) / 20 AS b FROM supplier)")
def resting_shares(spark, sf_dir):
    """The share of time a chain of two states rests in the first."""

    def rest(batches):
        for batch in batches:
            warm = [mechanism.stationary(np.array([[1 - a, a], [b, 1 - b]]))[0] for a, b in zip(batch["a"], batch["b"])]
            yield pd.DataFrame({"s_suppkey": batch["s_suppkey"], "warm": np.round(warm, 9)})

    s = table(spark, sf_dir, "supplier").select("s_suppkey", (0.01 + F.col("s_suppkey") % 50 / 100).alias("a"), (0.05 + F.col("s_nationkey") % 10 / 20).alias("b"))
    return s.mapInPandas(rest, "s_suppkey bigint, warm double")


_SHARES = "x AS (SELECT l_orderkey AS g, l_linenumber AS v, [l_discount, l_tax, 1 - l_discount - l_tax] AS p FROM lineitem)"


def _shares(spark, sf_dir):
    rest = 1 - F.col("l_discount") - F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("v"), F.array("l_discount", "l_tax", rest).alias("p"))


@query(f"WITH {_SHARES} SELECT a.g, round(max((abs(a.p[1] - b.p[1]) + abs(a.p[2] - b.p[2]) + abs(a.p[3] - b.p[3])) / 2), 9) AS strength FROM x a JOIN x b ON a.g = b.g GROUP BY 1")
def edge_strengths(spark, sf_dir):
    return scoring.most_variation(_shares(spark, sf_dir), "g", "p").withColumn("strength", F.round("strength", 9))


@query(f"WITH {_SHARES}, e AS (SELECT g, v, i - 1 AS place, p[i] AS p FROM x, range(1, 4) r(i)), w AS (SELECT *, sum(p) OVER (PARTITION BY g, place) AS s, count(*) OVER (PARTITION BY g, place) AS n FROM e) SELECT g, v, place::INTEGER AS place, round(abs(p - coalesce((s - p) / nullif(n - 1, 0), 0)), 9) AS moved FROM w")
def token_contrasts(spark, sf_dir):
    return scoring.contrasts(_shares(spark, sf_dir), "g", "v", "p").withColumn("moved", F.round("moved", 9))


def _conditional(spark, sf_dir, parent: str, child: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(parent, child).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(parent))).drop("n")


@query("WITH m AS (SELECT l_linestatus AS s, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT l_returnflag AS f, l_linenumber AS c, count(*) AS n FROM lineitem GROUP BY ALL), a AS (SELECT s, f, n / sum(n) OVER (PARTITION BY s) AS p FROM m), b AS (SELECT f, c, n / sum(n) OVER (PARTITION BY f) AS q FROM k) SELECT s AS l_linestatus, c AS l_linenumber, round(sum(p * q), 9) AS weight FROM a JOIN b USING (f) GROUP BY ALL")
def marginalised_effect(spark, sf_dir):
    """The distribution of the line number with the status set, the flag between them summed out."""
    start = table(spark, sf_dir, "lineitem").select("l_linestatus").distinct().withColumn("weight", F.lit(1.0))
    held = projection.merge_step(start, _conditional(spark, sf_dir, "l_linestatus", "l_returnflag"), ["l_linestatus"], ["l_linestatus", "l_returnflag"])
    end = projection.merge_step(held, _conditional(spark, sf_dir, "l_returnflag", "l_linenumber"), ["l_returnflag"], ["l_linestatus", "l_linenumber"])
    return end.withColumn("weight", F.round("weight", 9))


@query("WITH w AS (SELECT p_brand AS k, sum(p_retailprice) AS w FROM part GROUP BY 1), e AS (SELECT k, w / (SELECT sum(w) FROM w) * 1000 AS x FROM w), f AS (SELECT k, floor(x) AS a, x - floor(x) AS r, row_number() OVER (ORDER BY x - floor(x) DESC, k) AS i FROM e) SELECT k, (a + (i <= 1000 - (SELECT sum(a) FROM f))::INTEGER)::BIGINT AS n FROM f")
def largest_remainder(spark, sf_dir):
    """A thousand requests over brands by their prices."""
    from hopwright.topology import largest_remainder

    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("w")).orderBy("p_brand").collect()  # a row a brand
    return spark.createDataFrame(list(zip([r.p_brand for r in rows], largest_remainder([r.w for r in rows], 1000))), "k string, n long")


@query("SELECT o_orderkey, count(*) AS n, sum(l_linenumber) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def hops_of_requests(spark, sf_dir):
    """Requests with the hops that name them."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").cast("bigint").alias("parts"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(l, "o_orderkey")


@query("SELECT a.l_orderkey, a.l_linenumber, min(b.l_partkey) AS up FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber - 1 GROUP BY a.l_orderkey, a.l_linenumber")
def parents_of_hops(spark, sf_dir):
    """Each hop with the first attempt of its caller in the same request."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")  # noqa: E741
    first = l.groupBy("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber")).agg(F.min("l_partkey").alias("up"))
    return l.select("l_orderkey", "l_linenumber").distinct().join(first, ["l_orderkey", "l_linenumber"], "left")


@query("WITH s AS (SELECT event_type AS slot, event_id AS tick, (value > 50)::INTEGER AS state FROM events) SELECT l_orderkey, l_linenumber, s.state FROM (SELECT l_orderkey, l_linenumber, ['click', 'view', 'error'][l_linenumber % 3 + 1] AS slot, l_orderkey AS tick FROM lineitem) h ASOF LEFT JOIN s ON h.slot = s.slot AND h.tick >= s.tick".replace("LEFT JOIN s", "JOIN s"))
def state_at_hop(spark, sf_dir):
    """The state that was in force for each hop: the last change of its slot at or before its tick."""
    slot = F.element_at(F.array(*map(F.lit, ("click", "view", "error"))), F.col("l_linenumber") % 3 + 1)
    hops = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", slot.alias("slot"), F.col("l_orderkey").alias("tick"))
    changes = table(spark, sf_dir, "events").select(F.col("event_type").alias("slot"), F.col("event_id").alias("tick"), (F.col("value") > 50).cast("int").alias("state"))
    from hopwright.operators.latents import state_at

    return state_at(hops, changes, "slot", "tick", "state").select("l_orderkey", "l_linenumber", "state")


# Reports over split lines, and identities


@query("SELECT count(*) AS spans, count(*) FILTER (user_id % 4 = event_id % 4) AS cart_fallbacks FROM events")
def feed_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.struct((F.col("user_id") % 4 == F.col("event_id") % 4).alias("session_id_is_cart_fallback")).alias("keys"))
    return report.feed_counts(e)


@query("SELECT event_id, nullif(user_id % 4, event_id % 4) AS session_id, nullif(event_type, 'error') AS account FROM events")
def refused_keys(spark, sf_dir):
    """A session id that only repeats the cart's, and the account that stands for none, are no keys."""
    return table(spark, sf_dir, "events").select("event_id", F.nullif(F.col("user_id") % 4, F.col("event_id") % 4).alias("session_id"), F.nullif(F.col("event_type"), F.lit("error")).alias("account"))


@query("SELECT event_id, part, CASE WHEN part = 1 + user_id % (1 + event_id % 3) THEN event_type ELSE '-' END AS message FROM events, range(1, 4) r(part) WHERE part <= 1 + event_id % 3")
def split_lines(spark, sf_dir):
    """Lines split into parts; the text stands in one of them."""
    e = table(spark, sf_dir, "events").withColumn("n", 1 + F.col("event_id") % 3).withColumn("part", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return e.select("event_id", "part", F.when(F.col("part") == 1 + F.col("user_id") % F.col("n"), F.col("event_type")).otherwise("-").alias("message"))


@query(f"{_RUNS.format(gap=12 * 3600 * 1000)}, members AS (SELECT user_id || '|' || run AS q, event_type AS g FROM r) SELECT count(*) AS sequences, count(*) FILTER (k > 1) AS merged, round(count(*) FILTER (k > 1) / count(*), 9) AS merge_rate FROM (SELECT q, count(DISTINCT g) AS k FROM members GROUP BY 1)")
def merge_rate(spark, sf_dir):
    from hopwright.plans.driver_queries import runs

    m = runs(spark, sf_dir).select(F.concat_ws("|", "user_id", "run").alias("q"), F.col("event_type").alias("g"))
    return sequences.merge_rate(m, "g", "q").withColumn("merge_rate", F.round("merge_rate", 9))


# Sources and sinks


@query("SELECT event_id // 2000 AS shard, count(*) AS n, min(strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')) AS first, sum(event_id) AS ids FROM events GROUP BY 1")
def feed_round_trip(spark, sf_dir):
    """Records written as the raw feed, by shard, and read back."""
    at = _folder(spark, "feed")
    records = events(spark, sf_dir).select(F.floor(F.col("event_id") / 2000).alias("shard"), F.lit("vl.access").alias("kind"), S.iso_ms(F.col("ms")).alias("ts"), F.col("event_id").cast("string").alias("log_id"))
    corpus.write_feed(records, at)
    back = corpus.read_feed(spark, at)
    return back.groupBy(F.col("shard").cast("bigint").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.sum(F.col("log_id").cast("bigint")).alias("ids"))


@query("SELECT count(DISTINCT event_id // 2000) AS shards, min(event_id // 2000) AS first, max(event_id // 2000) AS last FROM events WHERE (event_id // 2000) % 2 = 0")
def committed_shards(spark, sf_dir):
    """Only shards with a marker are there."""
    at = _folder(spark, "shards")
    records = events(spark, sf_dir).select(F.floor(F.col("event_id") / 2000).alias("shard"), F.lit("vl.access").alias("kind"), F.col("event_id").cast("string").alias("log_id"), F.lit("t").alias("ts"))
    even = records.filter("shard % 2 = 0")
    registry.write_shards(even, even.select("shard", F.col("log_id").alias("span_id")), even.select("shard", "log_id"), at)
    corpus.write_feed(records.filter("shard % 2 = 1"), at)
    found = spark.createDataFrame([(int(s),) for s in corpus.completed_shards(spark, at)], "shard long")
    return found.agg(F.count(F.lit(1)).alias("shards"), F.min("shard").alias("first"), F.max("shard").alias("last"))


@query("SELECT CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS split, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM (SELECT ts, (('0x' || substr(md5(event_id::VARCHAR), 1, 8))::UBIGINT % 100)::BIGINT AS b FROM events) GROUP BY ALL")
def views_round_trip(spark, sf_dir):
    """View rows written by split and date, and read back."""
    at = _folder(spark, "views")
    corpus.write_views(events(spark, sf_dir).select("event_id", S.split_of(F.col("event_id")).alias("split"), S.day_of(F.col("ms")).alias("date")), at)
    return spark.read.parquet(at).groupBy("split", F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_name AS path, CASE WHEN r_regionkey = 0 THEN 'missing' WHEN r_regionkey = 1 THEN 'changed' ELSE 'unlisted' END AS problem FROM region WHERE r_regionkey IN (0, 1, 2)")
def manifest_check(spark, sf_dir):
    """Files that were listed and are gone, are other than listed, or are there unlisted."""
    at = _folder(spark, "files")
    names = [(r.r_regionkey, r.r_name) for r in table(spark, sf_dir, "region").collect()]  # five
    for key, name in names:
        if key != 0:
            registry.write_text(spark, f"{at}/{name}", f"content of {name}")
    found = corpus.manifest(spark, at)
    listed = found.filter(~F.col("path").isin([n for k, n in names if k == 2])).withColumn("sha256", F.when(F.col("path").isin([n for k, n in names if k == 1]), "other").otherwise(F.col("sha256")))
    gone = spark.createDataFrame([(n, "x") for k, n in names if k == 0], "path string, sha256 string")
    return corpus.manifest_problems(listed.select("path", "sha256").unionByName(gone), found)


@query(f"{_RUNS.format(gap=2 * 3600 * 1000)} SELECT user_id, run_start AS start_ms, run_end AS end_ms, n FROM (SELECT user_id, run, min(ms) AS run_start, max(ms) AS run_end, count(*) AS n FROM r GROUP BY ALL)")
def streamed_sessions(spark, sf_dir):
    """Sessions of a stream of files, the last ones closed by the end of the source."""
    source, out, checkpoint = (_folder(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    rows = events(spark, sf_dir).select("user_id", F.timestamp_millis("ms").alias("ts"))
    rows.repartitionByRange(4, "ts").write.parquet(source)
    run = lambda: streams.run_to_table(streams.stream_sessions(spark.readStream.schema(rows.schema).parquet(source), ["user_id"], gap="2 hours"), out, checkpoint).awaitTermination()
    run()
    streams.close_source(rows, source)
    run()
    return spark.read.parquet(out).select("user_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n")
