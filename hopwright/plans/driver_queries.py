"""Each operator of the library over the driver tables, with the same question in SQL.

Integers are cast to bigint and doubles rounded on both sides, as summation order differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopwright.functions import draws as D
from hopwright.functions import spans as S
from hopwright.operators import feed, graphs, latents, resolve, scoring, sequences, series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
GAP = 12 * 3600 * 1000


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ms", S.epoch_ms(F.col("ts")))


def runs(spark: SparkSession, sf_dir: str, gap: int = GAP) -> DataFrame:
    return sequences.with_runs(events(spark, sf_dir), ["user_id"], "ms", "event_id", gap)


_RUNS = """WITH e AS (SELECT *, (epoch_us(ts) // 1000) AS ms FROM events),
    m AS (SELECT *, CASE WHEN lag(ms) OVER w IS NULL OR ms - lag(ms) OVER w > {gap} THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id)::BIGINT AS run FROM m)"""
RUNS = _RUNS.format(gap=GAP)


@query(f"{RUNS} SELECT user_id, run, count(*) AS n_spans, count(*) FILTER (value > 100) AS n_err_spans, count(*) FILTER (value > 100) = 0 AS healthy, min(ms) AS start_ms, max(ms) AS end_ms FROM r GROUP BY ALL")
def session_sequences(spark, sf_dir):
    bad = F.count_if(F.col("value") > 100)
    return runs(spark, sf_dir).groupBy("user_id", "run").agg(
        F.count(F.lit(1)).alias("n_spans"), bad.alias("n_err_spans"), (bad == 0).alias("healthy"), F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms")
    )


@query(f"{RUNS} SELECT md5(user_id || '|' || (min(ms) // 60000)) AS sequence_id, user_id, count(*) AS n FROM r GROUP BY user_id, run")
def session_ids(spark, sf_dir):
    rows = runs(spark, sf_dir).groupBy("user_id", "run").agg(F.min("ms").alias("t0"), F.count(F.lit(1)).alias("n"))
    return rows.select(sequences.run_id([F.col("user_id")], F.col("t0")).alias("sequence_id"), "user_id", "n")


def _views(spark, sf_dir, ordering):
    order = Window.partitionBy("user_id", "run").orderBy("ms", "event_id")
    rows = runs(spark, sf_dir).select(
        "user_id", "run", F.col("event_id").alias("span_id"), F.col("event_type").alias("op"), S.outcome_of(F.lit(200), F.col("value"), F.lit(100.0)).alias("outcome"),
        F.col("ms").alias("start_ms"), (F.col("ms") + F.col("value").cast("bigint")).alias("end_ms"), F.lag("event_id").over(order).alias("parent"), F.lit(0).alias("depth"),
    )
    v = sequences.view_rows(rows, ["user_id", "run"], ordering)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return v.select("user_id", "run", text("ops"), text("outcomes"), text("offsets"), text("durations"), text("parent_pos"), "healthy", F.col("n_spans").cast("bigint").alias("n_spans"), "start_ns")


def _views_sql(order: str) -> str:
    return f"""{RUNS}, s AS (SELECT user_id, run, event_id, event_type AS op, CASE WHEN value > 100 THEN 4 ELSE 0 END AS outcome, ms AS s, ms + trunc(value)::BIGINT AS e, lag(event_id) OVER (PARTITION BY user_id, run ORDER BY ms, event_id) AS parent FROM r),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY {order}) - 1 AS pos, min(s) OVER (PARTITION BY user_id, run) AS t0 FROM s),
    q AS (SELECT p.*, coalesce(o.pos, -1) AS up FROM p LEFT JOIN p o ON o.user_id = p.user_id AND o.run = p.run AND o.event_id = p.parent)
    SELECT user_id, run, string_agg(op, ',' ORDER BY pos) AS ops, string_agg(outcome::VARCHAR, ',' ORDER BY pos) AS outcomes, string_agg(((s - t0) * 1000000)::VARCHAR, ',' ORDER BY pos) AS offsets,
           string_agg((greatest(0, e - s) * 1000000)::VARCHAR, ',' ORDER BY pos) AS durations, string_agg(up::VARCHAR, ',' ORDER BY pos) AS parent_pos,
           count(*) FILTER (outcome IN (1, 2, 3)) = 0 AS healthy, count(*) AS n_spans, min(t0) * 1000000 AS start_ns FROM q GROUP BY user_id, run"""


@query(_views_sql("e, -s, event_id"))
def sequence_view_end(spark, sf_dir):
    return _views(spark, sf_dir, "end")


@query(_views_sql("s, -e, event_id"))
def sequence_view_start(spark, sf_dir):
    return _views(spark, sf_dir, "start")


@query("SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text, count(*) AS parts_seen, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id")
def merge_parts(spark, sf_dir):
    return feed.merge_parts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("SELECT event_id, nullif(regexp_extract(props, '\"k\":\\s*(-?\\d+)', 1), '')::BIGINT AS k FROM events")
def harvest_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.text_number(F.col("props"), "k").alias("k"))


@query("SELECT event_id, CASE WHEN status IS NULL OR status = 0 THEN 3 WHEN status BETWEEN 400 AND 499 THEN 1 WHEN status >= 500 THEN 2 WHEN value > 50 THEN 4 ELSE 0 END AS outcome FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 200 END AS status FROM events)")
def outcome_class(spark, sf_dir):
    k = F.col("event_id") % 5
    status = F.when(k == 1, 404).when(k == 2, 503).when(k > 2, 200)
    return table(spark, sf_dir, "events").select("event_id", S.outcome_of(status, F.col("value"), F.lit(50.0)).alias("outcome"))


@query("SELECT event_type, arg_max(o, s)::INTEGER AS worst, max(s) AS severity FROM (SELECT event_type, o, CASE o WHEN 0 THEN 0 WHEN 4 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS s FROM (SELECT event_type, (user_id % 5)::INTEGER AS o FROM events)) GROUP BY 1")
def outcome_precedence(spark, sf_dir):
    o = (F.col("user_id") % 5).cast("int").alias("o")
    return table(spark, sf_dir, "events").select("event_type", o).groupBy("event_type").agg(S.worst_outcome(F.col("o")).alias("worst"), F.max(S.severity(F.col("o"))).alias("severity"))


@query("SELECT doc_id, b AS bucket, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UBIGINT % 100)::BIGINT AS b FROM documents)")
def split_assign(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.hash_bucket(F.col("doc_id")).alias("bucket"), S.split_of(F.col("doc_id")).alias("split"))


@query("SELECT page_id, CASE WHEN contains(url, '//') THEN '/' || array_to_string(string_split(url, '/')[4:], '/') ELSE url END AS path FROM pages")
def url_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.url_path(F.col("url")).alias("path"))


@query("SELECT page_id, translate(url, '/{}.', '____') AS col FROM pages WHERE NOT regexp_matches(url, '^https?://[a-z0-9.-]+(/[a-z]+)*/[0-9]+$')")
def name_grammar_scan(spark, sf_dir):
    bad = table(spark, sf_dir, "pages").filter(~F.col("url").rlike("^https?://[a-z0-9.-]+(/[a-z]+)*/[0-9]+$"))
    return bad.select("page_id", S.endpoint_column(F.col("url")).alias("col"))


@query("SELECT doc_id, string_agg(word, ',' ORDER BY word) AS words FROM (SELECT DISTINCT doc_id, word FROM documents, (SELECT unnest(['ondis', 'thean', 'kungs', 'zwis', 'aient', 'the and']) AS word) WHERE contains(lower(text), word)) GROUP BY doc_id")
def denylist_scan(spark, sf_dir):
    words = ["ondis", "thean", "kungs", "zwis", "aient", "the and"]
    docs = table(spark, sf_dir, "documents")
    low = F.lower("text")
    hits = F.array_sort(F.array_compact(F.array(*(F.when(low.contains(w), F.lit(w)) for w in words))))
    return docs.filter(low.rlike("|".join(words))).select("doc_id", F.array_join(hits, ",").alias("words"))


@query("SELECT event_type, b AS outcome, count(*) AS n FROM (SELECT event_type, CASE WHEN value > 120 THEN 3 WHEN value > 60 THEN 4 ELSE 0 END AS b FROM events WHERE (('0x' || substr(md5(user_id::VARCHAR), 1, 8))::UBIGINT % 100) < 80) GROUP BY ALL HAVING count(*) >= 20 AND b <> 0")
def vocab_variants(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(S.split_of(F.col("user_id")) == "train")
    outcome = F.when(F.col("value") > 120, 3).when(F.col("value") > 60, 4).otherwise(0)
    return e.select("event_type", outcome.alias("outcome")).groupBy("event_type", "outcome").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20 AND outcome <> 0")


@query("WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber AS a, l_suppkey % 10 AS b FROM lineitem), h AS (SELECT l_orderkey, sha1(string_agg(a || ',' || b, ';' ORDER BY a, b)) AS scenario_hash FROM p GROUP BY 1) SELECT scenario_hash, count(*) AS n FROM h GROUP BY 1")
def prevalence_hash(spark, sf_dir):
    pair = F.struct(F.col("l_linenumber").cast("bigint").alias("a"), (F.col("l_suppkey") % 10).alias("b"))
    h = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(sequences.pair_hash(F.collect_set(pair)).alias("scenario_hash"))
    return h.groupBy("scenario_hash").agg(F.count(F.lit(1)).alias("n"))


def _identities(spark, sf_dir):
    """Events as spans: session by props, device by user on some events, account by others; connectors by coarse ids."""
    e = table(spark, sf_dir, "events").withColumn("k", S.text_number(F.col("props"), "k"))
    v, i = F.col("user_id"), F.col("event_id")
    rows = F.array(
        F.struct(F.lit(0).alias("level"), F.when(i % 11 == 0, F.concat(F.lit("s"), F.col("k").cast("string"))).alias("key")),
        F.struct(F.lit(1).alias("level"), F.when(i % 7 == 0, F.concat(F.lit("d"), v.cast("string"))).alias("key")),
        F.struct(F.lit(2).alias("level"), F.when(i % 3 == 0, F.concat(F.lit("acc="), (v % 50).cast("string"))).alias("key")),
    )
    ids = e.select(F.col("event_id").alias("span_id"), F.inline(F.filter(rows, lambda r: r["key"].isNotNull())))
    ties = F.array(
        F.struct(F.concat(F.lit("request:"), F.floor(i / 4).cast("string")).alias("connector"), F.lit(True).alias("is_request")),
        F.struct(F.when(i % 2 == 0, F.concat(F.lit("btrace:"), F.floor(i / 20).cast("string"))).alias("connector"), F.lit(False).alias("is_request")),
    )
    con = e.select(F.col("event_id").alias("span_id"), F.inline(F.filter(ties, lambda r: r["connector"].isNotNull())))
    return e.select(F.col("event_id").alias("span_id")), ids, con


_IDS = """WITH e AS (SELECT *, nullif(regexp_extract(props, '"k":\\s*(-?\\d+)', 1), '') AS k FROM events),
    ids AS (SELECT event_id AS span_id, 0 AS level, 's' || k AS key FROM e WHERE event_id % 11 = 0 UNION ALL SELECT event_id, 1, 'd' || user_id FROM e WHERE event_id % 7 = 0 UNION ALL SELECT event_id, 2, 'acc=' || (user_id % 50) FROM e WHERE event_id % 3 = 0),
    ties AS (SELECT event_id AS span_id, 'request:' || (event_id // 4) AS connector, true AS is_request FROM e UNION ALL SELECT event_id, 'btrace:' || (event_id // 20), false FROM e WHERE event_id % 2 = 0),
    direct AS (SELECT DISTINCT connector, is_request, level, key FROM ties JOIN ids USING (span_id)),
    met AS (SELECT DISTINCT t.connector, q.connector AS request FROM ties t JOIN ties q USING (span_id) WHERE NOT t.is_request AND q.is_request),
    res AS (SELECT connector, level, key FROM direct UNION SELECT met.connector, level, key FROM met JOIN direct ON direct.is_request AND direct.connector = met.request)"""


@query(f"{_IDS} SELECT connector, level, key FROM res")
def identity_resolution(spark, sf_dir):
    _, ids, ties = _identities(spark, sf_dir)
    return resolve.resolve(ids, ties)


@query(f"{_IDS}, c AS (SELECT span_id, level, key FROM ids UNION SELECT span_id, level, key FROM ties JOIN res USING (connector)), b AS (SELECT span_id, level, key, row_number() OVER (PARTITION BY span_id ORDER BY level, key) AS n FROM c) SELECT e.event_id AS span_id, coalesce(level, 4) AS level, key FROM e LEFT JOIN b ON b.span_id = e.event_id AND n = 1")
def attribution_level(spark, sf_dir):
    spans, ids, ties = _identities(spark, sf_dir)
    return resolve.attribute(spans, ids, ties, resolve.resolve(ids, ties))


@query("""WITH h AS (SELECT user_id AS trace_id, event_id AS span_id, event_type AS service, CASE event_type WHEN 'click' THEN 'view' WHEN 'purchase' THEN 'click' ELSE 'click' END AS caller, (epoch_us(ts) // 1000) // 3600000 AS s, (epoch_us(ts) // 1000) // 3600000 + trunc(value * 3)::BIGINT AS e, event_id % 13 = 0 AS is_edge FROM events),
    p AS (SELECT h.trace_id, h.span_id, c.span_id AS cs, greatest(0, c.s - h.s) + greatest(0, h.e - c.e) AS v, c.e - c.s AS w FROM h JOIN h c ON h.trace_id = c.trace_id AND h.caller = c.service AND h.span_id <> c.span_id WHERE NOT h.is_edge),
    b AS (SELECT trace_id, span_id, arg_min(cs, (v, w, cs)) AS best FROM p WHERE v <= 60 GROUP BY ALL),
    g AS (SELECT trace_id, arg_min(span_id, (s, span_id)) AS edge FROM h WHERE is_edge GROUP BY 1)
    SELECT h.trace_id, h.span_id, CASE WHEN NOT is_edge THEN coalesce(best, edge) END AS parent FROM h LEFT JOIN b USING (trace_id, span_id) LEFT JOIN g USING (trace_id)""")
def parent_inference(spark, sf_dir):
    hour = F.floor(F.col("ms") / 3600000).cast("bigint")
    caller = F.when(F.col("event_type") == "click", "view").otherwise("click")
    hops = events(spark, sf_dir).select(
        F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), F.col("event_type").alias("service"), caller.alias("caller"), hour.alias("start_ms"),
        (hour + (F.col("value") * 3).cast("bigint")).alias("ts_ms"), (F.col("event_id") % 13 == 0).alias("is_edge"),
    )
    return resolve.containment_parents(hops).select("trace_id", "span_id", "parent")


@query("SELECT event_id, (((epoch_us(ts) // 1000) + 29999) // 30000) * 30000 AS scrape_ms FROM events")
def asof_next_grid(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", S.next_on_grid(F.col("ms"), 30000).alias("scrape_ms"))


_STATES = "WITH s AS (SELECT event_type, (epoch_us(ts) // 1000) // 1000 AS t, arg_max(floor(value / 50)::BIGINT, event_id) AS level FROM events GROUP BY ALL)"


def _states(spark, sf_dir):
    e = events(spark, sf_dir).select("event_type", F.floor(F.col("ms") / 1000).cast("bigint").alias("t"), F.floor(F.col("value") / 50).cast("bigint").alias("level"), "event_id")
    return e.groupBy("event_type", "t").agg(F.max_by("level", "event_id").alias("level"))


@query(f"{_STATES}, g AS (SELECT unnest(range(((SELECT min(t) FROM s) // 3600 + 1) * 3600, (SELECT max(t) FROM s), 3600)) AS t), k AS (SELECT DISTINCT event_type FROM s), p AS (SELECT event_type, t FROM k, g) SELECT p.event_type, p.t, s.level FROM p ASOF JOIN s ON p.event_type = s.event_type AND p.t >= s.t")
def scrape_samples(spark, sf_dir):
    s = _states(spark, sf_dir)
    # One row.
    span = s.agg(((F.floor(F.min("t") / 3600) + 1) * 3600).cast("bigint").alias("first"), F.max("t").alias("last"))
    return series.samples(s.join(F.broadcast(span)), ["event_type"], "t", "level", F.col("first"), F.col("last"), 3600)


_LOG = "d AS (SELECT *, lag(level) OVER (PARTITION BY event_type ORDER BY t) AS previous FROM s), c AS (SELECT * FROM d WHERE previous <> level)"


@query(f"{_STATES}, {_LOG} SELECT event_type, t, level, previous FROM c")
def state_changes(spark, sf_dir):
    return series.changes(_states(spark, sf_dir), ["event_type"], "t", "level")


@query(f"""{_STATES}, {_LOG}, v AS (SELECT *, (t + 3599) // 3600 * 3600 AS scrape FROM c), w AS (SELECT *, last_value(level) OVER (PARTITION BY event_type, scrape ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final, (SELECT max(t) FROM s) AS stop FROM v),
    x AS (SELECT event_type, CASE WHEN scrape < stop THEN final = level END AS visible FROM w)
    SELECT event_type, count(*) AS changes, count(*) FILTER (NOT visible) AS invisible, count(*) FILTER (visible IS NULL) AS unresolved, round(count(*) FILTER (NOT visible) / nullif(count(*) FILTER (visible IS NOT NULL), 0), 6) AS share_invisible FROM x GROUP BY 1""")
def sampling_loss(spark, sf_dir):
    s = _states(spark, sf_dir)
    end = s.agg(F.max("t")).first()[0]
    log = series.visible_changes(series.changes(s, ["event_type"], "t", "level"), ["event_type"], "t", "level", 3600, end or 0)
    return series.sampling_loss(log, "event_type").withColumn("share_invisible", F.round("share_invisible", 6))


@query("WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels), p AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c) SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM p")
def link_confusion(spark, sf_dir):
    c = table(spark, sf_dir, "labels").agg(*scoring.confusion(F.col("quality") == 1, F.col("toxic") == 1))
    return scoring.prf(c).select("tp", "fp", "fn", "tn", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


_TWO = f"""{_RUNS.format(gap=GAP)}, m2 AS (SELECT *, CASE WHEN lag(ms) OVER w IS NULL OR ms - lag(ms) OVER w > {GAP // 2} THEN 1 ELSE 0 END AS new2 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
    b AS (SELECT user_id || ':' || run AS truth, user_id || ':' || sum(new2) OVER (PARTITION BY user_id ORDER BY ms, event_id)::BIGINT AS found FROM m2)"""


@query(f"""{_TWO}, k AS (SELECT truth, found, count(*) AS c FROM b GROUP BY ALL), n AS (SELECT truth, count(*) AS n FROM b GROUP BY 1), s AS (SELECT found, count(*) AS s FROM b GROUP BY 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY c DESC, found) AS rank, count(*) OVER (PARTITION BY truth) AS pieces FROM k)
    SELECT count(*) AS sessions, round(avg(c / (n + s - c)), 6) AS jaccard, round(avg((pieces > 1)::INTEGER), 6) AS split_rate FROM t JOIN n USING (truth) JOIN s USING (found) WHERE rank = 1""")
def session_recovery(spark, sf_dir):
    a = runs(spark, sf_dir).withColumn("truth", F.concat_ws(":", "user_id", "run")).drop("run")
    b = sequences.with_runs(a, ["user_id"], "ms", "event_id", GAP // 2).withColumn("found", F.concat_ws(":", "user_id", "run"))
    best = sequences.recovery(b.select("truth", "found"), "truth", "found")
    return best.agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg("jaccard"), 6).alias("jaccard"), F.round(F.avg((F.col("pieces") > 1).cast("int")), 6).alias("split_rate"))


@query("SELECT event_type, count(*) AS n, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + " FROM events GROUP BY 1")
def quantiles_by_tier(spark, sf_dir):
    q = series.exact_quantiles(table(spark, sf_dir, "events"), "event_type", "value")
    return q.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99")))


@query("SELECT event_type, count(*) AS n, round(avg((value > 100)::INTEGER), 6) AS rate FROM events GROUP BY 1 HAVING count(*) >= 200")
def error_rate_gate(spark, sf_dir):
    return series.gated_rate(table(spark, sf_dir, "events"), "event_type", F.col("value") > 100).withColumn("rate", F.round("rate", 6))


@query("SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS parents, round(count(*) / count(DISTINCT l_orderkey), 6) AS fan_out FROM lineitem WHERE l_orderkey IS NOT NULL")
def invoked_fanout(spark, sf_dir):
    return series.fan_out(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("fan_out", F.round("fan_out", 6))


_PMF = "WITH d AS (SELECT least(max(l_linenumber), 6)::INTEGER AS depth FROM lineitem GROUP BY l_orderkey), p AS (SELECT depth, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM d GROUP BY 1)"


@query(f"{_PMF} SELECT depth, n, round(share, 6) AS share FROM p")
def request_depth_pmf(spark, sf_dir):
    return series.depth_pmf(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", 6).withColumn("share", F.round("share", 6))


@query(f"{_PMF}, u AS (SELECT unnest(range(1, 8))::INTEGER AS depth, 1.0 / 7 AS q) SELECT round(sum(abs(coalesce(share, 0) - coalesce(q, 0))) / 2, 6) AS tv FROM p FULL JOIN u USING (depth)")
def depth_distance(spark, sf_dir):
    p = series.depth_pmf(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", 6)
    u = spark.range(1, 8).select(F.col("id").cast("int").alias("depth"), F.lit(1 / 7).alias("share"))
    return scoring.total_variation(p, u, "depth", "share").select(F.round("tv", 6).alias("tv"))


@query("WITH d AS (SELECT DISTINCT user_id, (epoch_us(ts) // 1000) AS ms FROM events), g AS (SELECT user_id, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS gap FROM d) SELECT count(*) AS n, round(quantile_cont(gap, 0.5), 6) AS p50, round(quantile_cont(gap, 0.9), 6) AS p90 FROM g WHERE gap > 1500")
def step_gaps(spark, sf_dir):
    g = series.response_gaps(events(spark, sf_dir), ["user_id"], "ms", 1500)
    return series.exact_quantiles(g.withColumn("all", F.lit(1)), "all", "gap", (0.5, 0.9)).select("n", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "n_chars", (F.col("quality") == 1).alias("y"))


_SCORED = "WITH s AS (SELECT doc_id, n_chars, quality = 1 AS y FROM labels JOIN documents USING (doc_id))"


@query(f"{_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM s), t AS (SELECT sum(r) FILTER (y) AS sr, count(*) FILTER (y)::DOUBLE AS p, count(*) FILTER (NOT y)::DOUBLE AS q FROM r) SELECT round((sr - p * (p + 1) / 2) / nullif(p * q, 0), 6) AS auroc FROM t")
def auroc(spark, sf_dir):
    return scoring.auroc(_scored(spark, sf_dir), "y", "n_chars").select(F.round("auroc", 6).alias("auroc"))


@query(f"{_SCORED}, r AS (SELECT y, row_number() OVER w AS k, sum(y::INTEGER) OVER w AS tp FROM s WINDOW w AS (ORDER BY n_chars DESC, doc_id)) SELECT round(sum(tp / k) FILTER (y) / nullif(count(*) FILTER (y), 0), 6) AS average_precision FROM r")
def average_precision(spark, sf_dir):
    return scoring.average_precision(_scored(spark, sf_dir), "y", "n_chars", "doc_id").select(F.round("average_precision", 6).alias("average_precision"))


@query(f"{_SCORED}, k AS (SELECT count(*) FILTER (y) AS k FROM s), t AS (SELECT y FROM (SELECT y, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM s), k WHERE n <= k) SELECT k, (SELECT count(*) FILTER (y) FROM t) AS hits, 2 * (k - (SELECT count(*) FILTER (y) FROM t)) AS shd FROM k")
def topk_shd(spark, sf_dir):
    return scoring.top_k_distance(_scored(spark, sf_dir), "y", "n_chars", "doc_id")


_SETS = "WITH t AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity > 25), p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_discount > 0.04)"


@query(f"{_SETS}, c AS (SELECT (SELECT count(*) FROM (FROM t INTERSECT FROM p)) AS tp, (SELECT count(*) FROM (FROM p EXCEPT FROM t)) AS fp, (SELECT count(*) FROM (FROM t EXCEPT FROM p)) AS fn) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, fp + fn AS shd FROM c")
def set_prf(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_quantity", "l_discount")  # noqa: E741
    found = scoring.edge_sets(l.filter("l_quantity > 25"), l.filter("l_discount > 0.04D"), ["a", "b"])
    return found.select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "shd")


@query("SELECT DISTINCT least(s_nationkey, c_nationkey) AS a, greatest(s_nationkey, c_nationkey) AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey")
def skeleton(spark, sf_dir):
    return scoring.undirected(_trade(spark, sf_dir), "s_nationkey", "c_nationkey")


def _trade(spark, sf_dir):
    l, s, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "orders", "customer"))
    return l.select("l_orderkey", "l_suppkey", "l_extendedprice").join(s, l["l_suppkey"] == s["s_suppkey"]).join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])


@query("SELECT a.n_regionkey AS src_group, b.n_regionkey AS dst_group, max(l_extendedprice) AS strength FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY ALL")
def coarsen_max(spark, sf_dir):
    edges = _trade(spark, sf_dir).groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.max("l_extendedprice").alias("strength"))
    return graphs.coarsen(edges, table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey")


@query("WITH f AS (SELECT unnest([1000.0, 50000.0, 200000.0, 400000.0])::DOUBLE AS floor), e AS (SELECT floor, 'c' || o_custkey AS s, 'o' || o_orderkey AS d FROM orders, f WHERE o_totalprice >= floor), n AS (SELECT floor, count(DISTINCT x) AS nodes FROM (SELECT floor, s AS x FROM e UNION ALL SELECT floor, d FROM e) GROUP BY 1) SELECT floor, count(*) AS edges, any_value(nodes) AS nodes, round(count(*) / (any_value(nodes) * (any_value(nodes) - 1)), 9) AS density FROM e JOIN n USING (floor) GROUP BY 1")
def floor_sweep(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("s"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("d"), "o_totalprice")
    return graphs.floor_sweep(o, [1000.0, 50000.0, 200000.0, 400000.0], "s", "d", "o_totalprice").withColumn("density", F.round("density", 9))


_LINKS = "WITH RECURSIVE n AS (SELECT event_id, lead(event_id) OVER w AS up, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), e AS (SELECT event_id AS a, up AS b FROM n WHERE up IS NOT NULL AND k % 12 <> 0)"


def _links(spark, sf_dir):
    """Each event leads to the next one of its user; every twelfth ends a chain."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("a"), F.lead("event_id").over(w).alias("b"), F.row_number().over(w).alias("k"))
    return e.filter("b is not null and k % 12 <> 0").select("a", "b")


@query(f"{_LINKS}, r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r")
def reachability(spark, sf_dir):
    return graphs.reachable(_links(spark, sf_dir), "a", "b")


@query("SELECT part, acyclic FROM (VALUES ('chains', true), ('closed', false)) v(part, acyclic)")
def acyclicity(spark, sf_dir):
    """The chains of events have no cycle; with a link from each chain's end back to its first event they have."""
    chains = _links(spark, sf_dir)
    back = chains.join(chains.select(F.col("a").alias("b")), "b", "left_anti").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return spark.createDataFrame([("chains", graphs.is_acyclic(chains, "a", "b")), ("closed", graphs.is_acyclic(chains.unionByName(back), "a", "b"))], "part string, acyclic boolean")


_BIP = "WITH e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS d FROM lineitem WHERE l_suppkey <> l_partkey UNION SELECT 's' || s_suppkey, 's' || (s_suppkey + 1) FROM supplier)"


@query(f"{_BIP}, x AS (SELECT * FROM e WHERE s <> d) SELECT a.s AS a, a.d AS c, b.s AS b FROM x a JOIN x b ON a.d = b.d AND a.s < b.s WHERE NOT EXISTS (SELECT 1 FROM x z WHERE (z.s = a.s AND z.d = b.s) OR (z.s = b.s AND z.d = a.s))")
def vstructures(spark, sf_dir):
    """Suppliers lead to their parts and to the next supplier."""
    a = table(spark, sf_dir, "lineitem").filter("l_suppkey <> l_partkey").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("s"), F.concat(F.lit("p"), F.col("l_partkey")).alias("d"))
    b = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("s"), F.concat(F.lit("s"), F.col("s_suppkey") + 1).alias("d"))
    return graphs.v_structures(a.unionByName(b), "s", "d")


@query(f"""{RUNS}, q AS (SELECT user_id, run, min(ms) AS a, max(ms) AS b FROM r GROUP BY ALL), z AS (SELECT min(ms) AS t FROM e), f AS (SELECT * FROM (VALUES (0, 20, 30), (1, 100, 140), (2, 400, 2000)) v(fault_index, lo, hi)),
    x AS (SELECT q.*, fault_index, t + lo * 3600000::BIGINT AS lo, t + hi * 3600000::BIGINT AS hi FROM q, f, z)
    SELECT user_id, run, fault_index, CASE WHEN a >= hi THEN -1 WHEN b < lo THEN 0 WHEN a >= lo AND b < hi THEN 1 ELSE 2 END AS phase FROM x""")
def fault_phase(spark, sf_dir):
    r = runs(spark, sf_dir)
    q = r.groupBy("user_id", "run").agg(F.min("ms").alias("a"), F.max("ms").alias("b"))
    f = spark.createDataFrame([(0, 20, 30), (1, 100, 140), (2, 400, 2000)], "fault_index int, lo bigint, hi bigint")
    x = q.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(r.agg(F.min("ms").alias("t"))))
    return x.select("user_id", "run", "fault_index", sequences.phase(F.col("a"), F.col("b"), F.col("t") + F.col("lo") * 3600000, F.col("t") + F.col("hi") * 3600000).alias("phase"))


@query("SELECT event_id, string_agg(event_type, ',') OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 50 PRECEDING AND CURRENT ROW) AS crumbs FROM events")
def breadcrumbs(spark, sf_dir):
    return feed.breadcrumbs(table(spark, sf_dir, "events"), "user_id", "ts", "event_type").select("event_id", F.array_join("crumbs", ",").alias("crumbs"))


def _mix_sql(z: str, k: int) -> str:
    """One scrambling round in arithmetic modulo 2^64."""
    m = "18446744073709551616::UHUGEINT"
    return f"a{k} AS (SELECT *, ({z}) AS x0_{k} FROM a{k - 1}), b{k} AS (SELECT *, (x0_{k} + {D.GOLDEN}::UHUGEINT) % {m} AS x1_{k} FROM a{k}), c{k} AS (SELECT *, (xor(x1_{k}, x1_{k} >> 30) * {D.MIX_A}::UHUGEINT) % {m} AS x2_{k} FROM b{k}), d{k} AS (SELECT *, (xor(x2_{k}, x2_{k} >> 27) * {D.MIX_B}::UHUGEINT) % {m} AS x3_{k} FROM c{k}), e{k} AS (SELECT *, xor(x3_{k}, x3_{k} >> 31) AS h{k} FROM d{k})"


def uniform_sql(seed: int, domain: int) -> str:
    m = "18446744073709551616::UHUGEINT"
    first = (seed & D.MASK) ^ (domain * D.MIX_A & D.MASK)
    steps = [_mix_sql(f"{first}::UHUGEINT", 1), _mix_sql("xor(h1, 2::UHUGEINT)", 2).replace("FROM a1)", "FROM e1)"), _mix_sql(f"xor(h2, (event_id::UHUGEINT * {D.GOLDEN}::UHUGEINT) % {m})", 3).replace("FROM a2)", "FROM e2)"), _mix_sql(f"xor(h3, (user_id::UHUGEINT * {D.GOLDEN}::UHUGEINT) % {m})", 4).replace("FROM a3)", "FROM e3)")]
    return f"WITH a0 AS (SELECT event_id, user_id FROM events), {', '.join(steps)}, u AS (SELECT event_id, (h4 >> 11)::DOUBLE / 9007199254740992 AS u FROM e4)"


@query(f"{uniform_sql(7, 3)} SELECT event_id, u FROM u")
def counter_uniforms(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", D.uniform(7, 3, F.col("event_id"), F.col("user_id")).alias("u"))


@query(f"{uniform_sql(7, 4)} SELECT event_id, (u >= 0.5)::INTEGER + (u >= 0.8)::INTEGER + (u >= 0.95)::INTEGER AS category FROM u")
def categorical_draw(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", D.uniform(7, 4, F.col("event_id"), F.col("user_id")).alias("u"))
    return e.select("event_id", D.categorical(F.col("u"), [0.5, 0.8, 0.95, 1.0]).alias("category"))


@query(f"{uniform_sql(7, 5)} SELECT event_id, round(CASE WHEN u <= 0 THEN 0.0 WHEN u <= 0.5 THEN u * 40 WHEN u <= 0.9 THEN 20 + (u - 0.5) * 200 WHEN u <= 0.95 THEN 100 + (u - 0.9) * 2000 WHEN u <= 0.99 THEN 200 + (u - 0.95) * 10000 ELSE 600 + (u - 0.99) * 120000 END, 6) AS duration FROM u")
def quantile_draw(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", D.uniform(7, 5, F.col("event_id"), F.col("user_id")).alias("u"))
    return e.select("event_id", F.round(D.quantile(F.col("u"), [0.0, 0.5, 0.9, 0.95, 0.99, 1.0], [0.0, 20.0, 100.0, 200.0, 600.0, 1800.0]), 6).alias("duration"))


@query("WITH h AS (SELECT o_orderpriority AS g, o_totalprice AS v FROM orders) SELECT g AS o_orderpriority, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(quantile_cont(v, 0.1), 4) AS p10, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.9), 4) AS p90 FROM h GROUP BY g")
def headline(spark, sf_dir):
    h = series.headline(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return h.select("o_orderpriority", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "p10", "p50", "p90")))


@query("SELECT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT DISTINCT x.p AS a, y.p AS b FROM (SELECT l_orderkey, l_partkey AS p FROM lineitem) x JOIN (SELECT l_orderkey, l_partkey AS p FROM lineitem) y USING (l_orderkey) WHERE x.p < y.p)")
def support_pairs(spark, sf_dir):
    return graphs.co_occurring(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p")), "l_orderkey", "p")


@query("WITH b AS (SELECT c_mktsegment AS m, c_nationkey AS n, avg(c_acctbal) AS v FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL), a AS (SELECT c_mktsegment AS m, c_nationkey AS n, avg(c_acctbal) AS v FROM customer WHERE c_custkey % 2 = 1 GROUP BY ALL) SELECT m, n, round(coalesce(b.v, 0), 6) AS before, round(coalesce(a.v, 0), 6) AS after, (coalesce(b.v, 0) >= 5000) <> (coalesce(a.v, 0) >= 5000) AS flips FROM b FULL JOIN a USING (m, n) WHERE coalesce(b.v, 0) <> coalesce(a.v, 0)")
def changed_edges(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("m"), F.col("c_nationkey").alias("n"), "c_custkey", "c_acctbal")
    side = lambda k: c.filter(F.col("c_custkey") % 2 == k).groupBy("m", "n").agg(F.avg("c_acctbal").alias("v"))
    return graphs.changed_edges(side(0), side(1), ["m", "n"], "v", 5000.0).select("m", "n", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "flips")


_TOKENS = "WITH t AS (SELECT DISTINCT n_nationkey % 7 AS op, (n_nationkey % 7) || ':' || (n_regionkey) AS token FROM nation), s AS (SELECT DISTINCT least(a, b) AS op_a, greatest(a, b) AS op_b FROM (SELECT s_nationkey % 7 AS a, (s_suppkey % 7)::INTEGER AS b FROM supplier) WHERE a <> b)"


@query(f"{_TOKENS}, o AS (SELECT x.token AS src, y.token AS dst FROM s JOIN t x ON x.op = op_a JOIN t y ON y.op = op_b) SELECT src, dst FROM o UNION SELECT dst, src FROM o")
def token_universe(spark, sf_dir):
    op = F.col("n_nationkey") % 7
    tokens = table(spark, sf_dir, "nation").select(op.alias("op"), F.concat_ws(":", op.cast("string"), F.col("n_regionkey").cast("string")).alias("token")).distinct()
    pairs = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 7).alias("a"), (F.col("s_suppkey") % 7).cast("int").alias("b"))
    return graphs.token_universe(tokens, scoring.undirected(pairs, "a", "b").select(F.col("a").alias("op_a"), F.col("b").alias("op_b")))


@query("WITH RECURSIVE l AS (SELECT user_id AS row, event_id AS id, CASE WHEN n % 4 <> 0 THEN up END AS parent FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)), d AS (SELECT row, id, 0 AS depth FROM l WHERE parent IS NULL UNION ALL SELECT l.row, l.id, d.depth + 1 FROM l JOIN d ON l.row = d.row AND l.parent = d.id) SELECT row, id, depth FROM d")
def link_depths(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("row"), F.col("event_id").alias("id"), F.lag("event_id").over(w).alias("up"), F.row_number().over(w).alias("n"))
    return sequences.depths(e.select("row", "id", F.when(F.col("n") % 4 != 0, F.col("up")).alias("parent")))


@query("WITH e AS (SELECT s_nationkey AS src, (s_suppkey % 25)::INTEGER AS dst, s_acctbal FROM supplier WHERE s_nationkey <> s_suppkey % 25), t AS (SELECT least(src, dst) AS x, greatest(src, dst) AS y, bit_or(CASE WHEN src < dst THEN 1 ELSE 2 END | CASE WHEN s_acctbal < 0 THEN 4 ELSE 0 END) AS s FROM e WHERE s_acctbal < 5000 GROUP BY ALL), p AS (SELECT least(src, dst) AS x, greatest(src, dst) AS y, bit_or(CASE WHEN src < dst THEN 1 ELSE 2 END | CASE WHEN s_acctbal >= 9000 THEN 4 ELSE 0 END) AS s FROM e WHERE s_acctbal >= 5000 GROUP BY ALL) SELECT count(*) FILTER (t.s IS DISTINCT FROM p.s) AS shd FROM t FULL JOIN p USING (x, y)")
def mixed_shd(spark, sf_dir):
    """Each supplier is on one side by its balance, and the ends of the range are confounded as well."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("src"), (F.col("s_suppkey") % 25).cast("int").alias("dst"), "s_acctbal").filter("src <> dst")
    state = lambda side, both: scoring.mixed_states(s.filter(side), s.filter(both).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return scoring.mixed_distance(state("s_acctbal < 5000", "s_acctbal < 0"), state("s_acctbal >= 5000", "s_acctbal >= 9000"))


@query("SELECT o_custkey, o_orderstatus, arg_max(coalesce(o_totalprice, 1), o_orderkey) AS score FROM orders GROUP BY ALL")
def prediction_keep_last(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("score", F.col("o_totalprice"))
    return scoring.keep_last(o, ["o_custkey", "o_orderstatus"], "o_orderkey")


@query("SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_returnflag)) AS l_returnflag FROM lineitem GROUP BY l_orderkey")
def last_attempt(spark, sf_dir):
    return feed.last_by(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")


@query("SELECT event_type, count(*) AS n, round(count(*) FILTER (within) / count(*), 6) AS share FROM (SELECT event_type, abs(value - 50) <= greatest(0.01, 0.1 * 50) AS within FROM events) GROUP BY 1")
def tolerance_share(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ok", S.within_tolerance(F.col("value"), F.lit(50.0)))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if("ok") / F.count(F.lit(1)), 6).alias("share"))


@query(None)
def latent_trajectories(spark, sf_dir):
    """A thousand ticks of the hidden state of one service per nation, two endpoints each."""
    services = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("service"), F.array(2 * F.col("n_nationkey"), 2 * F.col("n_nationkey") + 1).alias("endpoints"))
    return latents.trajectories(spark, services, 0, 1000, [0] * 400 + [2] * 300 + [1] * 300, 7)
