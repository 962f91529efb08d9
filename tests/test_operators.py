"""Operators on hand-made rows with literal expected results."""

import math
import random

from pyspark.sql import functions as F

from hopwright.functions import draws, spans
from hopwright.operators import feed, graphs, resolve, scoring, sequences, series

FEED = (
    "kind string, ts string, log_id string, pod string, service string, host string, method string, path string, status int, request_time double, request_id string, "
    "trace_id string, client_ip string, part int, total_parts int, message string, log_source string, page_url string, sentry_trace_id string, duration_ms bigint, device_id string, account_id string"
)


def records(spark, *rows):
    names = [c.split()[0] for c in FEED.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], FEED)


def test_parts_out_of_order_merge(spark):
    rows = [("a", 3, "c"), ("a", 1, "x"), ("a", 2, None), ("b", 1, "")]
    got = {r.id: (r.text, r.parts_seen) for r in feed.merge_parts(spark.createDataFrame(rows, "id string, n int, text string"), "id", "n", "text").collect()}
    assert got == {"a": ("xc", 3), "b": ("", 1)}


def test_normalise_kinds_and_cart_fallback(spark):
    ts = "2026-01-05T09:00:00.001Z"
    app = {"kind": "vl.app", "ts": ts, "log_id": "l1", "total_parts": 2}
    got = feed.normalise(
        records(
            spark,
            app | {"part": 2, "message": 'id": "r1", "session_id": "c1"'},
            app | {"part": 1, "message": '"cart_id": "c1", "request_'},
            {"kind": "vl.access", "ts": ts, "log_id": "l2", "request_id": "r2", "client_ip": "1.2.3.4", "status": 200, "request_time": 1.5},
            {"kind": "sentry.error", "ts": ts, "log_id": "l3", "account_id": "empty", "device_id": "d"},
            {"kind": "other", "ts": ts, "log_id": "l4"},
        )
    ).collect()
    by = {r.span_id: r for r in got}
    assert set(by) == {"l1", "l2", "l3"}
    assert by["l1"]["keys"].request_id == "r1" and by["l1"]["keys"].session_id is None and by["l1"]["keys"].session_id_is_cart_fallback
    assert by["l2"]["keys"].client_ip == "1.2.3.4" and by["l2"].http.request_time == 1.5
    assert by["l3"]["keys"].account is None and by["l3"]["keys"].device_id == "d"
    assert by["l2"].ts_ms == 1767603600001


def test_gap_of_just_the_limit_stays(spark):
    m = 60_000
    df = spark.createDataFrame([("u", i, t) for i, t in enumerate([0, 30 * m, 60 * m + 1])], "u string, id int, ms bigint")
    assert [r.run for r in sequences.with_runs(df, ["u"], "ms", "id").orderBy("ms").collect()] == [1, 1, 2]


def test_containment_ties(spark):
    h = "trace_id string, span_id string, service string, caller string, start_ms bigint, ts_ms bigint, is_edge boolean"
    rows = [
        ("t", "edge", "web", None, 0, 1000, True), ("t", "p2", "a", "x", 100, 500, False), ("t", "p1", "a", "x", 100, 500, False), ("t", "wide", "a", "x", 50, 600, False),
        ("t", "child", "b", "a", 150, 400, False), ("t", "late", "b", "a", 150, 661, False), ("t", "far", "b", "a", 150, 662, False),
    ]
    got = {r.span_id: r.parent for r in resolve.containment_parents(spark.createDataFrame(rows, h)).collect()}
    assert got["child"] == "p1" and got["edge"] is None and got["p1"] == "edge"
    assert got["late"] == "edge" and got["far"] == "edge"
    shifted = {r.span_id: r.parent for r in resolve.containment_parents(spark.createDataFrame(rows[:-2] + [("t", "late", "b", "a", 150, 660, False)], h)).collect()}
    assert shifted["late"] == "wide"


def test_trace_hops_edges_and_truncation(spark):
    ts = "2026-01-05T09:00:00.000Z"
    s = feed.normalise(
        records(
            spark,
            {"kind": "vl.access", "ts": ts, "log_id": "e", "request_id": "r1", "trace_id": "t", "client_ip": "9.9.9.9", "service": "web", "request_time": 1.001},
            {"kind": "vl.access", "ts": ts, "log_id": "h", "request_id": "r2", "trace_id": "t", "client_ip": "10.0.0.1", "service": "a", "request_time": 0.1},
        )
    )
    ips = spark.createDataFrame([("10.0.0.1", "web")], "ip string, service string")
    got = {r.span_id: r for r in resolve.containment_parents(resolve.trace_hops(s, ips)).collect()}
    assert got["e"].is_edge and got["e"].request_time_ms == int(1.001 * 1000) and got["h"].parent == "e"


def test_transaction_links_through_an_error(spark):
    ts = "2026-01-05T09:00:00.000Z"
    s = feed.normalise(
        records(
            spark,
            {"kind": "vl.access", "ts": ts, "log_id": "edge", "request_id": "r1"},
            {"kind": "sentry.error", "ts": ts, "log_id": "err", "request_id": "r1", "sentry_trace_id": "st"},
            {"kind": "sentry.transaction", "ts": ts, "log_id": "txn", "sentry_trace_id": "st"},
        )
    )
    assert {tuple(r) for r in resolve.client_links(s).collect()} == {("err", "edge"), ("txn", "edge")}


def test_attribution_prefers_the_strongest_level(spark):
    ids = spark.createDataFrame([("a", 2, "acc=z"), ("b", 0, "s2"), ("c", 0, "s1"), ("d", 3, "1.1.1.1")], "span_id string, level int, key string")
    ties = spark.createDataFrame([("a", "request:1", True), ("b", "request:1", True), ("c", "request:1", True), ("e", "btrace:9", False), ("a", "btrace:9", False)], "span_id string, connector string, is_request boolean")
    all_spans = spark.createDataFrame([(x,) for x in "abcdef"], "span_id string")
    got = {r.span_id: (r.level, r.key) for r in resolve.attribute(all_spans, ids, ties, resolve.resolve(ids, ties)).collect()}
    assert got == {"a": (0, "s1"), "b": (0, "s1"), "c": (0, "s1"), "d": (4, None), "e": (0, "s1"), "f": (4, None)}


def test_millisecond_tie_is_decided_by_depth(spark):
    rows = [("t", "kid", 2, 0, 5, 5, "top", 1), ("t", "top", 1, 3, 5, 5, None, 0)]
    df = spark.createDataFrame(rows, "trace string, span_id string, op int, outcome int, start_ms bigint, end_ms bigint, parent string, depth int")
    end, start = (sequences.view_rows(df, ["trace"], o).first() for o in ("end", "start"))
    assert end.ops == [2, 1] and end.parent_pos == [1, -1] and not end.healthy and end.n_err_spans == 1
    assert start.ops == [1, 2] and start.parent_pos == [-1, 0] and start.scenario_hash == end.scenario_hash


def test_phase_table(spark):
    df = spark.createDataFrame([(0, 9), (10, 19), (5, 10), (15, 25), (20, 30), (9, 10)], "a bigint, b bigint")
    got = [r[0] for r in df.select(sequences.phase(F.col("a"), F.col("b"), F.lit(10), F.lit(20))).collect()]
    assert got == [0, 1, 2, 2, -1, 2]


def test_depths_with_a_chain(spark):
    n = 40
    rows = [("r", str(i), str(i - 1) if i else None) for i in range(n)] + [("q", "x", "outside")]
    got = {(r.row, r.id): r.depth for r in sequences.depths(spark.createDataFrame(rows, "row string, id string, parent string")).collect()}
    assert all(got["r", str(i)] == i for i in range(n)) and got["q", "x"] == 0


def test_depths_end_at_cycles(spark):
    rows = [("r", "a", "b"), ("r", "b", "a"), ("r", "c", "a"), ("r", "d", "d"), ("s", "a", "z"), ("s", "x", "a")]
    got = {(r.row, r.id): r.depth for r in sequences.depths(spark.createDataFrame(rows, "row string, id string, parent string")).collect()}
    assert got == {("r", "a"): 1, ("r", "b"): 0, ("r", "c"): 2, ("r", "d"): 0, ("s", "a"): 0, ("s", "x"): 1}


def plain_auroc(y, s):
    pairs = [(a > b) + 0.5 * (a == b) for a, p in zip(s, y) if p for b, q in zip(s, y) if not q]
    return sum(pairs) / len(pairs) if pairs else None


def test_rank_scores_with_ties(spark):
    rng = random.Random(3)
    for n in (1, 7, 40):
        y, s = [rng.random() < 0.4 for _ in range(n)], [rng.choice([1.0, 0.5, 0.0, -0.0, -1.0]) for _ in range(n)]
        df = spark.createDataFrame(list(zip(range(n), y, s)), "pos int, y boolean, s double")
        want = plain_auroc(y, s)
        got = scoring.auroc(df, "y", "s").first()[0]
        assert (got is None and want is None) or math.isclose(got, want)
        order = sorted(range(n), key=lambda i: (-s[i], i))
        hits, total = 0, 0.0
        for k, i in enumerate(order, 1):
            hits += y[i]
            total += y[i] * hits / k
        got = scoring.average_precision(df, "y", "s", "pos").first()[0]
        assert (got is None and not any(y)) or math.isclose(got, total / sum(y))


def test_mixed_distance(spark):
    none = spark.createDataFrame([], "a string, b string")
    truth = scoring.mixed_states(spark.createDataFrame([("a", "b"), ("c", "b")], "src string, dst string"), none)
    pred = scoring.mixed_states(spark.createDataFrame([("b", "a")], "src string, dst string"), spark.createDataFrame([("c", "b")], "a string, b string"))
    assert scoring.mixed_distance(truth, pred).first()[0] == 2 and scoring.mixed_distance(truth, truth).first()[0] == 0


def forced_by_orientations(edges):
    """Edges with the same direction in every acyclic graph of the same skeleton and v-structures."""
    nodes = sorted({x for e in edges for x in e})

    def shape(es):
        near = {frozenset(e) for e in es}
        return {(frozenset((a, b)), c) for a, c in es for b, d in es if c == d and a < b and frozenset((a, b)) not in near}

    def acyclic(es):
        left = set(nodes)
        while left:
            free = {x for x in left if not any(b == x and a in left for a, b in es)}
            if not free:
                return False
            left -= free
        return True

    pairs = [tuple(sorted(e)) for e in edges]
    same = []
    for k in range(2 ** len(pairs)):
        es = [p if k >> i & 1 else p[::-1] for i, p in enumerate(pairs)]
        if acyclic(es) and shape(es) == shape(edges):
            same.append(set(es))
    return set.intersection(*same)


def test_compelled_edges_by_all_orientations(spark):
    rng = random.Random(6)
    cases = [[("p", "q"), ("p", "r"), ("p", "s"), ("q", "s"), ("r", "s")], [("u", "v"), ("w", "v"), ("v", "x"), ("x", "y"), ("v", "y")]]
    for _ in range(3):
        cases.append([(f"n{a}", f"n{b}") for a in range(5) for b in range(a + 1, 5) if rng.random() < 0.6])
    for edges in filter(None, cases):
        got = {(r.src, r.dst) for r in graphs.compelled(spark.createDataFrame(edges, "src string, dst string")).collect() if r.compelled}
        assert got == forced_by_orientations(edges), edges


def test_acyclic(spark):
    df = lambda rows: spark.createDataFrame(rows, "s string, d string")
    assert graphs.is_acyclic(df([("a", "b"), ("b", "c")]), "s", "d") and not graphs.is_acyclic(df([("a", "b"), ("b", "a"), ("b", "c")]), "s", "d")


def test_visible_changes(spark):
    log = spark.createDataFrame([("n", 5, 1), ("n", 7, 0), ("n", 12, 1), ("n", 31, 0)], "k string, t bigint, v int")
    got = {r.t: r.visible for r in series.visible_changes(log, ["k"], "t", "v", 10, 40).collect()}
    assert got == {5: False, 7: True, 12: True, 31: None}


def test_draws_repeat_and_keep_their_distribution(spark):
    df = spark.range(4000).select("id", draws.uniform(1, 2, F.col("id")).alias("u"), draws.uniform(1, 3, F.col("id")).alias("v"))
    a = df.repartition(7).orderBy("id").collect()
    assert a == df.orderBy("id").collect()
    us = [r.u for r in a]
    assert abs(sum(us) / len(us) - 0.5) < 0.02 and min(us) >= 0 and max(us) < 1
    mean = df.agg(F.avg(draws.poisson(F.col("u"), 2.0)), F.avg(draws.normal(F.col("u"), F.col("v")))).first()
    assert abs(mean[0] - 2) < 0.1 and abs(mean[1]) < 0.06


def test_spans_expressions(spark):
    one = spark.range(1)
    f = lambda c: one.select(c).first()[0]
    assert f(spans.url_path(F.lit("https://h/a/b?x"))) == "/a/b?x" and f(spans.url_path(F.lit("/a"))) == "/a"
    assert f(spans.start_ms(F.lit(5000), F.lit(1.001))) == 5000 - int(1.001 * 1000)
    assert f(spans.next_on_grid(F.lit(31), 30)) == 60 and f(spans.next_on_grid(F.lit(60), 30)) == 60
    assert [f(spans.outcome_of(F.lit(s).cast("int"), F.lit(2.0), F.lit(1.0))) for s in (None, 0, 404, 500, 200)] == [3, 3, 1, 2, 4]


def test_queries_over_all_rows_read_every_row(spark, tmp_path):
    from hopwright import catalog

    # The worst outcome is in the event that outcome_precedence leaves out.
    spark.createDataFrame([(0, 0, "x"), (5, 3, "x")], "event_id bigint, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in catalog.QUERIES["outcome_precedence"](spark, str(tmp_path)).collect()] == [("x", 3, 4)]
    # Suppliers 1 and 5 are on neither side of mixed_shd; 7 and 32 have the same edge, but one of them is confounded.
    rows = [(1, 2, 10.0), (5, 2, 6000.0), (7, 2, -1.0), (32, 2, 6000.0)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    assert catalog.QUERIES["mixed_shd"](spark, str(tmp_path)).first()[0] == 3
