"""Identity resolution through connectors, attribution, and parents by interval containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwright.functions import spans as S

#: Attribution levels, the strongest first.
LEVELS = {"session": 0, "device": 1, "user": 2, "ip": 3}
NONE = 4
TOLERANCE_MS = 60


def identities(spans: DataFrame) -> DataFrame:
    """(span_id, level code, key) of every identity a span carries itself."""
    k = F.col("keys")
    rows = F.array(
        F.struct(F.lit(0).alias("level"), k["session_id"].alias("key")), F.struct(F.lit(1).alias("level"), k["device_id"].alias("key")),
        F.struct(F.lit(2).alias("level"), F.concat(F.lit("acc="), k["account"]).alias("key")),
        F.struct(F.lit(3).alias("level"), F.when((F.col("kind") == "vl.access") & ~S.is_internal(k["client_ip"]), k["client_ip"]).alias("key")),
    )
    return spans.select("span_id", F.inline(F.filter(rows, lambda r: F.coalesce(r["key"], F.lit("")) != "")))


def connectors(spans: DataFrame) -> DataFrame:
    """(span_id, connector, is_request) of every id that ties spans together."""
    k = F.col("keys")
    named = lambda kind, c: F.struct(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{kind}:"), c)).alias("connector"), F.lit(kind == "request").alias("is_request"))
    rows = F.array(
        named("request", k["request_id"]), named("request", F.when(~k["correlation_id"].eqNullSafe(k["request_id"]), k["correlation_id"])),
        named("btrace", k["trace_id"]), named("strace", k["sentry_trace_id"]), named("cart", k["cart_id"]),
    )
    return spans.select("span_id", F.inline(F.filter(rows, lambda r: r["connector"].isNotNull()))).distinct()


def resolve(ids: DataFrame, ties: DataFrame) -> DataFrame:
    """(connector, level, key): what the spans of a connector carry, plus, for connectors that are no requests, what the requests they occur with carry. One round."""
    direct = ties.join(ids, "span_id").select("connector", "is_request", "level", "key").distinct()
    request = ties.filter("is_request").select("span_id", F.col("connector").alias("request"))
    met = ties.filter("NOT is_request").join(request, "span_id").select("connector", "request").distinct()
    carried = met.join(direct.filter("is_request").select(F.col("connector").alias("request"), "level", "key"), "request").select("connector", "level", "key")
    return direct.select("connector", "level", "key").unionByName(carried).distinct()


def attribute(spans: DataFrame, ids: DataFrame, ties: DataFrame, resolved: DataFrame, use_ip: bool = False) -> DataFrame:
    """(span_id, level, key) of each span: the strongest level with any candidate, of those the smallest key; level 4 without any."""
    allowed = F.lit(use_ip) | (F.col("level") != 3)
    # Only a connector's best key can be a span's: one row each meets the spans, however many keys it has.
    own = resolved.filter(allowed).groupBy("connector").agg(F.min(F.struct("level", "key")).alias("best")).select("connector", "best.level", "best.key")
    through = ties.select("span_id", "connector").join(own, "connector").select("span_id", "level", "key")
    candidates = ids.select("span_id", "level", "key").filter(allowed).unionByName(through)
    best = candidates.groupBy("span_id").agg(F.min(F.struct("level", "key")).alias("best"))
    return spans.select("span_id").join(best, "span_id", "left").select("span_id", F.coalesce("best.level", F.lit(NONE)).alias("level"), F.col("best.key").alias("key"))


def containment_parents(hops: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """The parent of each hop: of the hops of its caller's service in the same trace the one that contains it best.

    ``hops``: trace_id, span_id, service, caller, start_ms, ts_ms, is_edge. Least violation first, then least width, then span id;
    without one within the tolerance, the trace's earliest edge hop. Edge hops have no parent. The equi-join on trace and
    service keeps candidates few; the interval test is its residual.
    """
    c = hops.select(F.col("trace_id").alias("c_trace"), F.col("service").alias("c_service"), F.col("span_id").alias("c_span"), F.col("start_ms").alias("c_start"), F.col("ts_ms").alias("c_end"))
    inner = hops.filter(~F.col("is_edge"))
    violation = F.greatest(F.lit(0), F.col("c_start") - F.col("start_ms")) + F.greatest(F.lit(0), F.col("ts_ms") - F.col("c_end"))
    pairs = inner.join(c, (F.col("trace_id") == F.col("c_trace")) & (F.col("caller") == F.col("c_service")) & (F.col("span_id") != F.col("c_span")) & (violation <= tolerance_ms))
    best = pairs.groupBy("trace_id", "span_id").agg(F.min(F.struct(violation.alias("v"), (F.col("c_end") - F.col("c_start")).alias("w"), F.col("c_span").alias("s"))).alias("best"))
    edge = hops.filter("is_edge").groupBy("trace_id").agg(F.min(F.struct("start_ms", "span_id")).alias("edge"))
    found = hops.join(best, ["trace_id", "span_id"], "left").join(edge, "trace_id", "left")
    return found.withColumn("parent", F.when(~F.col("is_edge"), F.coalesce("best.s", "edge.span_id"))).drop("best", "edge")


def trace_hops(spans: DataFrame, services: DataFrame) -> DataFrame:
    """Access spans as hops with their edges marked and the caller's service looked up by address (``services``: ip, service)."""
    k, h = F.col("keys"), F.col("http")
    lines = spans.filter(F.col("kind").isin("vl.app", "vl.audit") & (k["request_id"] != k["correlation_id"]))
    named = lines.groupBy(k["request_id"].alias("request_id")).agg(F.max_by(k["correlation_id"], F.struct("ts_ms", "span_id")).alias("correlation_id"))
    hops = spans.filter((F.col("kind") == "vl.access") & k["trace_id"].isNotNull()).select(
        k["trace_id"].alias("trace_id"), "span_id", "ts_ms", S.start_ms(F.col("ts_ms"), h["request_time"]).alias("start_ms"), k["request_id"].alias("request_id"),
        "service", h["path"].alias("path"), h["status"].alias("status"), (F.coalesce(h["request_time"], F.lit(0.0)) * 1000).cast("bigint").alias("request_time_ms"), k["client_ip"].alias("client_ip"),
    )
    hops = hops.join(named, "request_id", "left")
    edges = hops.filter("correlation_id is not null").select("trace_id", F.col("correlation_id").alias("request_id")).distinct().withColumn("named", F.lit(True))
    hops = hops.join(edges, ["trace_id", "request_id"], "left")
    hops = hops.withColumn("is_edge", F.coalesce("named", F.lit(False)) | ~S.is_internal(F.col("client_ip"))).drop("named")
    return hops.join(services.select(F.col("ip").alias("client_ip"), F.col("service").alias("caller")), "client_ip", "left")


def client_links(spans: DataFrame) -> DataFrame:
    """(span_id, edge_span): client records to the access record of their request, transactions through an error of the same front-end trace."""
    k = F.col("keys")
    access = spans.filter((F.col("kind") == "vl.access") & k["request_id"].isNotNull()).groupBy(k["request_id"].alias("rid")).agg(F.max_by("span_id", F.struct("ts_ms", "span_id")).alias("edge_span"))
    errors = spans.filter((F.col("kind") == "sentry.error") & k["request_id"].isNotNull()).select("span_id", "ts_ms", k["request_id"].alias("rid"), k["sentry_trace_id"].alias("strace"))
    through = errors.filter("strace is not null").groupBy("strace").agg(F.max_by("rid", F.struct("ts_ms", "span_id")).alias("rid"))
    txns = spans.filter((F.col("kind") == "sentry.transaction")).select("span_id", k["sentry_trace_id"].alias("strace")).join(through, "strace").select("span_id", "rid")
    return errors.select("span_id", "rid").unionByName(txns).join(access, "rid").select("span_id", "edge_span")
