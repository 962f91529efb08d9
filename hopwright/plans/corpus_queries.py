"""Queries of views, reports, scores, states and registries over the driver tables, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopwright.functions import draws as D
from hopwright.functions import ids
from hopwright.functions import spans as S
from hopwright.operators import evaluation, graphs, latents, report, sequences, series, views
from hopwright.plans.driver_queries import RUNS, runs, table, uniform_sql
from hopwright.sources import registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# Views


_OPS = "ops AS (SELECT n_nationkey AS op, r_name AS service, n_name AS name, (n_nationkey % 4)::INTEGER AS kind FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _ops(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").alias("op_id"), F.col("r_name").alias("service"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 4).alias("kind"))


@query(f"WITH {_OPS}, c AS (SELECT c_custkey, r_name AS service, n_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON (n_regionkey + c_custkey % 2) % 5 = r_regionkey) SELECT c_custkey, op FROM c JOIN ops ON c.service = ops.service AND path = name WHERE kind <> 2")
def op_index_join(spark, sf_dir):
    """Customers are records of a service and path; half of them name a service that has no such path."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.join(table(spark, sf_dir, "region"), (F.col("n_regionkey") + F.col("c_custkey") % 2) % 5 == F.col("r_regionkey")).select("c_custkey", F.col("r_name").alias("service"), F.col("n_name").alias("path"))
    return views.with_op(c, views.op_index(_ops(spark, sf_dir))).select("c_custkey", "op")


@query(f"WITH {_OPS} SELECT c_custkey, op FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN ops ON '/' || n_name = '/' || name WHERE kind = 2")
def client_op_join(spark, sf_dir):
    ops = views.op_index(_ops(spark, sf_dir)).withColumn("name", F.concat(F.lit("/"), "name"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return views.with_client_op(c.select("c_custkey", F.concat(F.lit("https://app.example/"), "n_name").alias("path")), ops).select("c_custkey", "op")


def _rows(spark, sf_dir, ordering):
    """Runs of events as view rows: the parent of an event is the one before it, in the order of the clock."""
    order = Window.partitionBy("user_id", "run").orderBy("ms", "event_id")
    s = runs(spark, sf_dir).select(
        "user_id", "run", F.col("event_id").alias("span_id"), F.hash("event_type").alias("op"), S.outcome_of(F.lit(200), F.col("value"), F.lit(100.0)).alias("outcome"),
        F.col("ms").alias("start_ms"), (F.col("ms") + (F.col("value") * 100_000).cast("bigint")).alias("end_ms"), F.lag("event_id").over(order).alias("parent"), F.lit(0).alias("depth"),
    )
    return sequences.view_rows(s, ["user_id", "run"], ordering)


def _orientation_sql(order: str, wrong: str) -> str:
    return f"""{RUNS}, s AS (SELECT user_id, run, event_id, ms AS s, ms + trunc(value * 100000)::BIGINT AS e, lag(event_id) OVER (PARTITION BY user_id, run ORDER BY ms, event_id) AS parent FROM r),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY {order}) AS pos FROM s),
    l AS (SELECT p.pos, o.pos AS up FROM p JOIN p o ON o.user_id = p.user_id AND o.run = p.run AND o.event_id = p.parent)
    SELECT count(*) AS links, count(*) FILTER ({wrong}) AS violations, round(count(*) FILTER ({wrong}) / greatest(count(*), 1), 9) AS rate FROM l"""


@query(_orientation_sql("e, -s, event_id", "up <= pos"))
def orientation_end(spark, sf_dir):
    return views.orientation(_rows(spark, sf_dir, "end"), "end").withColumn("rate", F.round("rate", 9))


@query(_orientation_sql("s, -e, event_id", "up >= pos"))
def orientation_start(spark, sf_dir):
    return views.orientation(_rows(spark, sf_dir, "start"), "start").withColumn("rate", F.round("rate", 9))


_SPLIT = "CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END"


@query(f"""WITH g AS (SELECT o.x AS ordering, g.x AS grain, s.x AS split FROM (VALUES ('end'), ('start')) o(x), (VALUES ('request'), ('session')) g(x), (VALUES ('train'), ('val'), ('test')) s(x)),
    d AS (SELECT {_SPLIT} AS split, CASE WHEN event_id % 2 = 0 THEN 'end' ELSE 'start' END AS ordering FROM (SELECT event_id, (('0x' || substr(md5(event_id::VARCHAR), 1, 8))::UBIGINT % 100)::BIGINT AS b FROM events)),
    c AS (SELECT ordering, 'request' AS grain, split, count(*) AS n FROM d GROUP BY ALL)
    SELECT ordering, grain, split, coalesce(n, 0) AS rows FROM g LEFT JOIN c USING (ordering, grain, split)""")
def zero_filled_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(S.split_of(F.col("event_id")).alias("split"), F.when(F.col("event_id") % 2 == 0, "end").otherwise("start").alias("ordering"), F.lit("request").alias("grain"))
    return views.row_counts(e)


@query(f"""{RUNS}, t AS (SELECT r.*, {_SPLIT} AS split FROM r JOIN (SELECT DISTINCT user_id, (('0x' || substr(md5(user_id::VARCHAR), 1, 8))::UBIGINT % 100)::BIGINT AS b FROM r) USING (user_id))
    SELECT event_type AS op, o AS outcome, count(*) AS n FROM (SELECT event_type, CASE WHEN value > 100 THEN 4 ELSE 0 END AS o FROM t WHERE split = 'train') WHERE o <> 0 GROUP BY ALL HAVING count(*) >= 5""")
def vocabulary(spark, sf_dir):
    rows = runs(spark, sf_dir).withColumn("outcome", S.outcome_of(F.lit(200), F.col("value"), F.lit(100.0))).groupBy("user_id", "run").agg(F.collect_list(F.struct("event_type", "outcome")).alias("m"))
    rows = rows.select(S.split_of(F.col("user_id")).alias("split"), F.transform("m", lambda x: x["event_type"]).alias("ops"), F.transform("m", lambda x: x["outcome"]).alias("outcomes"))
    return views.vocabulary(views.token_counts(rows), 5)


@query("WITH e AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS lead_id FROM events), c AS (SELECT event_id // 3 AS calls, arg_max(event_id, (ts, event_id)) AS caller FROM events WHERE event_type = 'error' GROUP BY 1) SELECT event_id, user_id, lead_id, coalesce(caller, lead_id) AS parent FROM e LEFT JOIN c ON calls = event_id")
def client_becomes_parent(spark, sf_dir):
    """A later client record replaces the parent of the edge hop that it calls."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("lead_id", F.lag("event_id").over(w))
    callers = e.filter("event_type = 'error'").groupBy(F.floor(F.col("event_id") / 3).alias("calls")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("caller"))
    return e.join(callers, F.col("event_id") == F.col("calls"), "left").select("event_id", "user_id", "lead_id", F.coalesce("caller", "lead_id").alias("parent"))


@query(f"""{RUNS}, q AS (SELECT user_id, run, min(ms) AS a, max(ms) AS b, list(event_type ORDER BY ms, event_id) AS ops, list((value > 100)::INTEGER ORDER BY ms, event_id) AS bad FROM r GROUP BY ALL), z AS (SELECT min(ms) AS t FROM e),
    f AS (SELECT * FROM (VALUES (0, 20.0, 30.0, ['error']), (1, 100.0, 400.0, ['click', 'view'])) v(fault_index, lo, hi, causes)),
    x AS (SELECT q.*, fault_index, causes, t + lo * 3600000 AS lo, t + hi * 3600000 AS hi FROM q, f, z),
    y AS (SELECT *, list_filter(range(len(ops)), lambda i: list_contains(causes, ops[i + 1])) AS rc FROM x)
    SELECT user_id || '-' || run AS trace_id, fault_index, CASE WHEN a >= hi THEN -1 WHEN b < lo THEN 0 WHEN a >= lo AND b < hi THEN 1 ELSE 2 END AS phase, array_to_string(rc, ',') AS positions, coalesce(list_bool_or(list_transform(rc, lambda i: bad[i + 1] <> 0)), false) AS rc_took FROM y""")
def sequence_labels(spark, sf_dir):
    r = runs(spark, sf_dir)
    m = F.array_sort(F.collect_list(F.struct("ms", "event_id", "event_type", (F.col("value") > 100).cast("int").alias("bad"))))
    q = r.groupBy("user_id", "run").agg(m.alias("m"), F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"))
    ops = F.transform("m", lambda x: x["event_type"])
    rows = q.select(F.concat_ws("-", "user_id", "run").alias("trace_id"), "start_ms", "end_ms", ops.alias("ops_end"), ops.alias("ops_start"), F.transform("m", lambda x: x["bad"]).alias("outcomes_end"))
    first = r.agg(F.min("ms").alias("t"))
    shifted = rows.join(F.broadcast(first)).withColumns({"start_ms": F.col("start_ms") - F.col("t"), "end_ms": F.col("end_ms") - F.col("t")}).drop("t")
    faults = spark.createDataFrame([(0, 72_000.0, 108_000.0, ["error"]), (1, 360_000.0, 1_440_000.0, ["click", "view"])], "fault_index int, start_s double, end_s double, causes array<string>")
    return sequences.fault_labels(shifted, faults).select("trace_id", "fault_index", "phase", F.array_join(F.transform("rc_positions_end", lambda i: i.cast("string")), ",").alias("positions"), "rc_took")


# Reports


_LINKED = "WITH h AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AS is_edge, CASE WHEN l_linenumber > 1 THEN l_suppkey END AS t, CASE WHEN l_tax > 0 THEN l_partkey % 100 END AS p FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag, l_tax, l_discount FROM lineitem))"


def _hops(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("span_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag", "l_tax", "l_discount"))  # noqa: E741
    return l.dropDuplicates(["span_id"]).select("span_id", (F.col("l_returnflag") == "A").alias("is_edge"), F.when(F.col("l_linenumber") > 1, F.col("l_suppkey")).alias("parent"), F.when(F.col("l_tax") > 0, F.col("l_partkey") % 100).alias("guess"))


@query(f"""{_LINKED}, k AS (SELECT CASE WHEN is_edge THEN 'edge' ELSE 'internal' END AS kind, t, p FROM h UNION ALL SELECT 'all', t, p FROM h),
    c AS (SELECT kind, count(*) FILTER (t = p) AS tp, count(*) FILTER ((t IS NULL AND p IS NOT NULL) OR t <> p) AS fp, count(*) FILTER ((t IS NOT NULL AND p IS NULL) OR t <> p) AS fn, count(*) FILTER (t IS NULL AND p IS NULL) AS tn FROM k GROUP BY 1)
    SELECT *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM c""")
def parent_link_confusion(spark, sf_dir):
    """True and inferred parents of line items, with kinds; a wrong parent counts twice."""
    h = _hops(spark, sf_dir)
    got = report.link_confusion(h.select("span_id", "is_edge", "parent"), h.select("span_id", F.col("guess").alias("parent")))
    return got.select("kind", "tp", "fp", "fn", "tn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("SELECT ['session', 'device', 'user', 'ip', 'none'][coalesce(CASE WHEN value > 20 THEN user_id % 4 END, 4) + 1] AS level, count(*) AS n FROM events GROUP BY 1")
def level_histogram(spark, sf_dir):
    return report.level_histogram(table(spark, sf_dir, "events").select(F.when(F.col("value") > 20, F.col("user_id") % 4).alias("level")))


@query("""WITH e AS (SELECT event_id, event_type, CASE WHEN value > 20 THEN user_id % 4 END AS level, value > 60 AS linked FROM events), h AS (SELECT count(*) FILTER (NOT (l_linenumber = 1) AND l_tax = 0) AS orphans FROM lineitem)
    SELECT count(*) AS spans, count(*) FILTER (level IS NULL) AS unattributed, count(*) FILTER (event_type = 'error') AS client_errors, count(*) FILTER (event_type = 'error' AND linked) AS client_linked, any_value(orphans) AS orphan_internal_hops,
    round(count(*) FILTER (level IS NULL) / count(*), 9) AS unattributed_fraction, round(count(*) FILTER (event_type = 'error' AND linked) / greatest(count(*) FILTER (event_type = 'error'), 1), 9) AS client_error_linked_fraction FROM e, h""")
def correlation_losses(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("span_id"), F.when(F.col("event_type") == "error", "sentry.error").otherwise("vl.access").alias("kind"), F.when(F.col("value") > 20, F.col("user_id") % 4).alias("level"), "value")
    hops = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") == 1).alias("is_edge"), F.when(F.col("l_tax") > 0, F.col("l_suppkey")).alias("parent"))
    out = report.losses(e.select("span_id", "kind"), e.filter("level is not null").select("span_id", "level"), e.filter("value > 60").select("span_id"), hops)
    return out.withColumns({c: F.round(c, 9) for c in ("unattributed_fraction", "client_error_linked_fraction")})


@query("""WITH m AS (SELECT l_orderkey AS g, CASE WHEN l_tax > 0.01 THEN l_orderkey // 3 * 10 + l_linenumber // 3 END AS q FROM lineitem), n AS (SELECT g, count(*) AS n FROM m GROUP BY 1), c AS (SELECT g, q, count(*) AS c FROM m WHERE q IS NOT NULL GROUP BY ALL), s AS (SELECT q, count(*) AS s FROM m WHERE q IS NOT NULL GROUP BY 1),
    b AS (SELECT g, arg_min(c, (-c, q)) AS c, arg_min(s, (-c, q)) AS s, count(*) AS pieces FROM c JOIN s USING (q) GROUP BY 1), p AS (SELECT coalesce(c / (n + s - c), 0) AS j, coalesce(pieces, 0) AS pieces FROM n LEFT JOIN b USING (g)),
    o AS (SELECT count(*) AS sequences, count(*) FILTER (k > 1) AS merged FROM (SELECT q, count(DISTINCT g) AS k FROM m WHERE q IS NOT NULL GROUP BY 1))
    SELECT count(*) AS true_sessions, round(avg(j), 9) AS mean_jaccard, count(*) FILTER (pieces > 1) AS split, round(count(*) FILTER (pieces > 1) / count(*), 9) AS split_rate, any_value(sequences) AS sequences, any_value(merged) AS merged, round(any_value(merged) / any_value(sequences), 9) AS merge_rate FROM p, o""")
def session_recovery_report(spark, sf_dir):
    found = F.when(F.col("l_tax") > 0.01, F.floor(F.col("l_orderkey") / 3) * 10 + F.floor(F.col("l_linenumber") / 3))
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), found.alias("q"))
    return report.recovery_summary(m, "g", "q").withColumns({c: F.round(c, 9) for c in ("mean_jaccard", "split_rate", "merge_rate")})


# Scores


def _graphs(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    edge = lambda rows, a, b: rows.select(F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst")).filter("src <> dst").distinct()
    t = edge(l.filter("l_quantity > 30"), "l_suppkey", "l_partkey").unionByName(edge(l.filter("l_quantity > 45"), "l_partkey", "l_suppkey")).distinct()
    p = edge(l.filter("l_discount > 0.05"), "l_suppkey", "l_partkey").unionByName(edge(l.filter("l_tax > 0.06"), "l_partkey", "l_suppkey")).distinct()
    b = lambda rows: rows.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both_t, both_p = b(edge(l.filter("l_quantity > 49"), "l_suppkey", "l_partkey")), b(edge(l.filter("l_discount > 0.09"), "l_suppkey", "l_partkey"))
    return evaluation.Graph(t, both_t), evaluation.Graph(p, both_p)


def _edge_sql(where: str, a: str, b: str) -> str:
    return f"SELECT DISTINCT {a}::VARCHAR AS src, {b}::VARCHAR AS dst FROM lineitem WHERE {where} AND {a} <> {b}"


_S, _P = "l_suppkey", "l_partkey"
_MIXED = f"""WITH t AS ({_edge_sql('l_quantity > 30', _S, _P)} UNION {_edge_sql('l_quantity > 45', _P, _S)}), p AS ({_edge_sql('l_discount > 0.05', _S, _P)} UNION {_edge_sql('l_tax > 0.06', _P, _S)}),
    tb AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ({_edge_sql('l_quantity > 49', _S, _P)})), pb AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ({_edge_sql('l_discount > 0.09', _S, _P)}))"""


@query(f"""{_MIXED}, one AS (SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM t r WHERE r.src = t.dst AND r.dst = t.src) AND NOT EXISTS (SELECT 1 FROM tb WHERE a = least(t.src, t.dst) AND b = greatest(t.src, t.dst))),
    sk AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM p UNION SELECT a, b FROM pb),
    m AS (SELECT one.*, EXISTS (SELECT 1 FROM p WHERE p.src = one.src AND p.dst = one.dst) AND NOT EXISTS (SELECT 1 FROM p WHERE p.src = one.dst AND p.dst = one.src) AS ok FROM one JOIN sk ON a = least(src, dst) AND b = greatest(src, dst))
    SELECT count(*) AS n, count(*) FILTER (ok) AS correct, round(count(*) FILTER (ok) / nullif(count(*), 0), 9) AS accuracy FROM m""")
def orientation_accuracy(spark, sf_dir):
    t, p = _graphs(spark, sf_dir)
    return evaluation.orientation(t, p).select("n", "correct", F.round("accuracy", 9).alias("accuracy"))


@query(f"""{_MIXED}, ts AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM t UNION SELECT a, b FROM tb), ps AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM p UNION SELECT a, b FROM pb),
    c AS (SELECT 'directed' AS axis, (SELECT count(*) FROM (FROM t INTERSECT FROM p)) AS tp, (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM p) AS np UNION ALL SELECT 'skeleton', (SELECT count(*) FROM (FROM ts INTERSECT FROM ps)), (SELECT count(*) FROM ts), (SELECT count(*) FROM ps)
          UNION ALL SELECT 'bidirected', (SELECT count(*) FROM (FROM tb INTERSECT FROM pb)), (SELECT count(*) FROM tb), (SELECT count(*) FROM pb))
    SELECT axis, tp, np - tp AS fp, nt - tp AS fn, nt + np - 2 * tp AS shd, round(coalesce(2 * tp / nullif(nt + np, 0), 0), 9) AS f1 FROM c""")
def score_axes(spark, sf_dir):
    t, p = _graphs(spark, sf_dir)
    return evaluation.axes(t, p).select("axis", "tp", "fp", "fn", "shd", F.round("f1", 9).alias("f1"))


@query(f"{_MIXED}, u AS (SELECT DISTINCT l_suppkey::VARCHAR AS src, l_partkey::VARCHAR AS dst FROM lineitem WHERE l_quantity < 40), i AS (SELECT p.* FROM p SEMI JOIN u USING (src, dst)) SELECT (SELECT count(*) FROM i) AS inside, (SELECT count(*) FROM p) - (SELECT count(*) FROM i) AS outside")
def universe_restriction(spark, sf_dir):
    _, p = _graphs(spark, sf_dir)
    pairs = table(spark, sf_dir, "lineitem").filter("l_quantity < 40").select(F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst")).distinct()
    none = evaluation.Graph(p.directed, p.bidirected.limit(0))
    return evaluation.inside(none, pairs).directed.agg(F.count(F.lit(1)).alias("inside")).withColumn("outside", F.lit(evaluation.outside_count(none, pairs)))


@query("""WITH e AS (SELECT l_suppkey || ':x' AS src, l_partkey || ':y' AS dst, l_suppkey AS a, l_partkey AS b, l_linenumber FROM lineitem), s AS (SELECT DISTINCT least(l_suppkey, l_linenumber) AS a, greatest(l_suppkey, l_linenumber) AS b FROM lineitem)
    SELECT DISTINCT src, dst FROM e JOIN s ON least(e.a, e.b) = s.a AND greatest(e.a, e.b) = s.b WHERE e.a <> e.b""")
def support_semi_join(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    edges = l.select(F.concat(F.col("l_suppkey"), F.lit(":x")).alias("src"), F.concat(F.col("l_partkey"), F.lit(":y")).alias("dst")).distinct()
    return graphs.supported(edges, l.select(F.col("l_suppkey").cast("int").alias("op_a"), F.col("l_linenumber").alias("op_b")).distinct(), "src", "dst")


@query("SELECT o_custkey, max(o_totalprice) AS strength, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS via FROM orders GROUP BY 1")
def strongest_way(spark, sf_dir):
    """Of several ways the strongest, of equal ones the first."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("strength"), F.col("o_orderkey").alias("via"), "o_orderkey")
    return graphs.strongest(o, ["o_custkey"], "o_orderkey")


@query("""WITH m AS (SELECT s_nationkey AS latent, s_suppkey AS token, s_acctbal / 10000 AS d0, (s_suppkey % 10) / 10 AS d1 FROM supplier), p AS (SELECT x.token AS a, y.token AS b, greatest(least(x.d0, y.d0), least(x.d1, y.d1)) AS s, x.latent FROM m x JOIN m y ON x.latent = y.latent AND x.token < y.token)
    SELECT a, b, round(max(s), 9) AS strength, max_by(latent, (s, latent)) AS via FROM p GROUP BY a, b HAVING max(s) > 0""")
def shared_causes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("latent"), F.col("s_suppkey").alias("token"), F.array(F.col("s_acctbal") / 10000, (F.col("s_suppkey") % 10) / 10).alias("delta"))
    return graphs.shared_causes(s).withColumn("strength", F.round("strength", 9))


@query("""WITH e AS (SELECT 'b' || s_nationkey AS x, 'b' || (s_suppkey % 25) AS y, s_acctbal FROM supplier WHERE s_nationkey <> s_suppkey % 25), n AS (SELECT 'b' || n_nationkey AS k, n_regionkey AS g FROM nation)
    SELECT least(p.g, q.g) AS a, greatest(p.g, q.g) AS b, max(s_acctbal) AS strength FROM e JOIN n p ON p.k = x JOIN n q ON q.k = y WHERE p.g <> q.g GROUP BY 1, 2""")
def coarsen_bidirected(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("b"), "s_nationkey").alias("a"), F.concat(F.lit("b"), F.col("s_suppkey") % 25).alias("b"), F.col("s_acctbal").alias("strength")).filter("a <> b")
    groups = table(spark, sf_dir, "nation").select(F.concat(F.lit("b"), "n_nationkey").alias("k"), F.col("n_regionkey").alias("g"))
    return graphs.coarsen_bidirected(s, groups, "k", "g")


@query("SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, count(*) OVER (PARTITION BY s_nationkey) > 1 AS compelled FROM supplier")
def compelled_edges(spark, sf_dir):
    """Suppliers lead into nations and nothing joins two suppliers: the edges into a shared nation are compelled."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    return graphs.compelled(s)


@query("SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'x', 'y'")
def topology_prior(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("caller"), F.concat(F.lit("n"), "n_nationkey").alias("callee"))
    return graphs.topology_prior(n.unionByName(spark.createDataFrame([("y", "x"), ("z", "z")], "caller string, callee string")))


# States and series


@query("SELECT round(count(*) FILTER (l_linenumber > 1) / nullif(count(*) FILTER (l_linenumber = 1), 0), 9) AS mean_retries FROM lineitem")
def mean_retries(spark, sf_dir):
    return series.mean_retries(table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_linenumber") - 1), "k").withColumn("mean_retries", F.round("mean_retries", 9))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax = 0 AND l_discount = 0 AND l_linestatus = 'F'")
def nominal_spans(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumns({"state_health": F.col("l_tax"), "state_pool": F.col("l_discount"), "state_cache": (F.col("l_linestatus") != "F").cast("int")})  # noqa: E741
    return series.nominal(l).select("l_orderkey", "l_linenumber")


@query("""WITH s AS (SELECT n_nationkey AS i, n_name AS n, (n_nationkey % 4)::INTEGER AS k FROM nation), o AS (SELECT s_suppkey::INTEGER AS id, s_nationkey AS svc, s_name AS n FROM supplier)
    SELECT 'traffic_intensity' AS family, NULL AS service, NULL AS endpoint, 'state:intensity' AS stem UNION ALL SELECT 'service_load', n, NULL, 'state:load:' || i FROM s WHERE k <> 2 UNION ALL SELECT 'endpoint_health', s.n, o.n, 'state:health:' || id FROM o JOIN s ON svc = i WHERE k <> 2""")
def metric_catalogue(spark, sf_dir):
    services = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 4).alias("kind"))
    ops = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_nationkey").alias("service"), F.col("s_name").alias("name"), F.lit(1).alias("kind"))
    return series.catalogue(services, ops, ["intensity", "load", "health"]).select("family", "service", "endpoint", "stem")


_LEVELS = "s AS (SELECT event_type, event_id AS t, (value > 50)::INTEGER AS level FROM events)"


@query(f"""WITH {_LEVELS}, c AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY event_type ORDER BY t), 0) AS previous FROM s), d AS (SELECT *, (t + 29) // 30 * 30 AS scrape FROM c WHERE previous <> level),
    e AS (SELECT *, last_value(level) OVER (PARTITION BY event_type, scrape ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM d)
    SELECT event_type, t, level, previous, CASE WHEN scrape < (SELECT max(t) FROM s) THEN final = level END AS visible, event_type IN ('click', 'error') AS exposed FROM e""")
def exposed_changes(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("t"), (F.col("value") > 50).cast("int").alias("level"))
    last = s.agg(F.max("t").alias("last"))
    log = series.change_log(s.join(F.broadcast(last)), ["event_type"], "t", "level", 30, F.col("last"), "event_type", ["click", "error"])
    return log.select("event_type", "t", "level", "previous", "visible", "exposed")


_CHAIN = ((0.7, 0.2, 0.1), (0.3, 0.5, 0.2), (0.1, 0.2, 0.7))


@query(f"""{uniform_sql(9, 1).replace('WITH a0', 'WITH RECURSIVE a0')}, q AS (SELECT event_id, user_id, u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM u JOIN events USING (event_id)),
    x AS (SELECT user_id, k, event_id, CASE WHEN u < 0.7 THEN 0 WHEN u < 0.9 THEN 1 ELSE 2 END AS value FROM q WHERE k = 1 UNION ALL
          SELECT q.user_id, q.k, q.event_id, CASE x.value WHEN 0 THEN CASE WHEN u < 0.7 THEN 0 WHEN u < 0.9 THEN 1 ELSE 2 END WHEN 1 THEN CASE WHEN u < 0.3 THEN 0 WHEN u < 0.8 THEN 1 ELSE 2 END ELSE CASE WHEN u < 0.1 THEN 0 WHEN u < 0.3 THEN 1 ELSE 2 END END FROM x JOIN q ON q.user_id = x.user_id AND q.k = x.k + 1)
    SELECT event_id, value FROM x""")
def lag1_chain(spark, sf_dir):
    """A chain per user: each event's state is drawn from the row of the state before it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", D.uniform(9, 1, F.col("event_id"), F.col("user_id")).alias("u"))
    return latents.lag1_chain(e, "user_id", "event_id", "u", _CHAIN).select("event_id", "value")


# Registries


@query("SELECT DISTINCT 'path' AS \"column\", regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS value FROM pages WHERE NOT regexp_full_match(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1), '/v1/[a-z]{4,12}/[a-z]{4,12}|/page/[a-z]{4,12}(/[a-z]{4,12})?|/healthz')")
def outside_grammar(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1).alias("path"))
    return registry.outside_grammar(p, "path")


_DENIED = ("customer#000000001", "customer#0000000010", "nation_1", "household")


@query("SELECT DISTINCT c_custkey, regexp_extract(lower(c_name || ' ' || c_mktsegment), '(customer#0000000010?|nation_1|household)', 1) AS name FROM customer WHERE regexp_matches(lower(c_name || ' ' || c_mktsegment), '(customer#000000001|nation_1|household)')".replace("0000000010?", "0000000010|customer#000000001"))
def denied_names(spark, sf_dir):
    """The longest of the denied names that begin together is found."""
    c = table(spark, sf_dir, "customer").select("c_custkey", registry.denied_name(F.concat_ws(" ", "c_name", "c_mktsegment"), list(_DENIED)).alias("name"))
    return c.filter("name is not null")


@query("SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderstatus = 'P' THEN 'only here' WHEN o_orderstatus = 'F' THEN 'differs' ELSE 'same' END AS status FROM orders")
def inventory_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), "o_orderkey").alias("path"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("sha256"), "o_orderstatus")
    remote = o.filter("o_orderstatus <> 'P'").withColumn("sha256", F.when(F.col("o_orderstatus") == "F", F.lit("other")).otherwise(F.col("sha256")))
    return registry.inventory_status(o, remote)


@query("SELECT 'to/f' || o_orderkey AS target, CASE WHEN o_orderstatus = 'P' THEN 'missing' WHEN o_orderkey % 3 = 0 THEN 'size' ELSE 'checksum' END AS problem FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 3 = 0 OR o_orderstatus = 'F'")
def release_problems(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), "o_orderkey").alias("path"), F.col("o_orderkey").alias("bytes"), F.lit("x").alias("sha256"), "o_orderstatus", "o_orderkey")
    plan = registry.upload_plan(files, "to")
    remote = files.filter("o_orderstatus <> 'P'").select(F.concat(F.lit("to/"), "path").alias("target"), F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(F.col("bytes")).alias("bytes"), F.when(F.col("o_orderstatus") == "F", "y").otherwise("x").alias("sha256"))
    return registry.release_problems(plan, remote)


@query(None)
def digest_split(spark, sf_dir):
    """Splits by the digest that other corpora use; BLAKE2b is no function of SQL."""
    return table(spark, sf_dir, "documents").select("doc_id", ids.split_of(F.col("doc_id")).alias("split"), ids.hex_id(32, F.lit("doc"), F.col("doc_id")).alias("id"))
