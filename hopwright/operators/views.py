"""Views of a corpus: operations of spans, request rows in both orderings, vocabulary, counts and orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwright.functions import spans as S
from hopwright.operators import sequences

#: The kind of a client's own operations, the orderings and splits of views, the tokens that are no operations.
CLIENT_KIND = 2
ORDERINGS, GRAINS, SPLITS = ("end", "start"), ("request", "session"), ("train", "val", "test")
SPECIALS = ("PAD", "BOS", "EOS", "UNK")


def op_index(alphabet: DataFrame) -> DataFrame:
    """(op, service, name, kind) of the operations in a token alphabet; state tokens have none."""
    return alphabet.filter("op_id is not null").select(F.col("op_id").alias("op"), "service", "name", "kind").distinct()


def with_op(records: DataFrame, ops: DataFrame, service: str = "service", path: str = "path") -> DataFrame:
    """``records`` with the operation of their service and path; those without one are dropped."""
    own = ops.filter(F.col("kind") != CLIENT_KIND).select(F.col("service").alias("__s"), F.col("name").alias("__p"), "op")
    return records.join(own, (F.col(service) == F.col("__s")) & (F.col(path) == F.col("__p"))).drop("__s", "__p")


def with_client_op(records: DataFrame, ops: DataFrame, page: str = "path") -> DataFrame:
    """Client records with the operation of the page they were on; those of other pages are dropped."""
    own = ops.filter(F.col("kind") == CLIENT_KIND).select(F.col("name").alias("__p"), "op")
    return records.join(own, S.url_path(F.col(page)) == F.col("__p")).drop("__p")


def trace_edges(hops: DataFrame) -> DataFrame:
    """(trace_id, edge): the earliest edge hop of each trace."""
    return hops.filter("is_edge").groupBy("trace_id").agg(F.min(F.struct("start_ms", "span_id")).alias("m")).select("trace_id", F.col("m.span_id").alias("edge"))


def build_spans(records: DataFrame, hops: DataFrame, attribution: DataFrame, ops: DataFrame, thresholds: DataFrame, links: DataFrame) -> DataFrame:
    """Hops and client records as spans: span_id, op, outcome, start_ms, end_ms, parent, kind, trace_id, level.

    ``hops`` have their parents; ``thresholds``: op, threshold_s; ``links``: span_id, edge_span. A client record that is linked to an
    edge hop starts a millisecond before it and becomes its parent; of several the last by time and id does. It belongs to the trace
    only if that hop is the trace's first edge.
    """
    levels = attribution.select("span_id", "level")
    inner = with_op(hops, ops).join(thresholds, "op", "left")
    seconds = F.col("request_time_ms") / 1000.0
    hop = inner.select("span_id", "op", S.outcome_of(F.col("status"), seconds, F.col("threshold_s")).alias("outcome"), "start_ms", F.col("ts_ms").alias("end_ms"), "parent", "trace_id")
    sentry = records.filter(F.col("kind").isin("sentry.error", "sentry.transaction")).select("span_id", "ts_ms", "kind", F.col("http.path").alias("path"), F.col("http.request_time").alias("seconds"))
    client = with_client_op(sentry, ops).join(links, "span_id", "left")
    edge = hop.select(F.col("span_id").alias("edge_span"), F.col("start_ms").alias("edge_start"))
    first = trace_edges(hops).select(F.col("edge").alias("edge_span"), F.col("trace_id").alias("edge_trace"))
    client = client.join(edge, "edge_span", "left").join(first, "edge_span", "left")
    length = F.greatest((F.coalesce("seconds", F.lit(0.0)) * 1000).cast("bigint"), F.lit(1))
    client = client.select(
        "span_id", "op", F.when(F.col("kind") == "sentry.error", S.ERROR).otherwise(S.OK).alias("outcome"), F.coalesce(F.col("edge_start") - 1, F.col("ts_ms") - length).alias("start_ms"),
        F.col("ts_ms").alias("end_ms"), F.lit(None).cast("string").alias("parent"), F.col("edge_trace").alias("trace_id"), F.when(F.col("edge_start").isNotNull(), F.col("edge_span")).alias("calls"),
    )
    caller = client.filter("calls is not null").groupBy("calls").agg(F.max_by("span_id", F.struct("end_ms", "span_id")).alias("caller"))
    hop = hop.join(caller, F.col("span_id") == F.col("calls"), "left").withColumn("parent", F.coalesce("caller", "parent")).drop("caller", "calls").withColumn("kind", F.lit("hop"))
    both = hop.unionByName(client.drop("calls").withColumn("kind", F.lit("client")))
    return both.join(levels, "span_id", "left").withColumn("level", F.coalesce("level", F.lit(4)))


def request_rows(spans: DataFrame, hops: DataFrame, attribution: DataFrame, ordering: str = "end") -> DataFrame:
    """One view row per trace, with its attribution level, split and date. A trace belongs to its edge hop's key, or to itself."""
    members = spans.filter("trace_id is not null")
    depth = sequences.depths(members.select(F.col("trace_id").alias("row"), F.col("span_id").alias("id"), "parent")).select(F.col("row").alias("trace_id"), F.col("id").alias("span_id"), "depth")
    rows = sequences.view_rows(members.join(depth, ["trace_id", "span_id"]), ["trace_id"], ordering)
    own = trace_edges(hops).join(attribution.select(F.col("span_id").alias("edge"), "level", "key"), "edge", "left").select("trace_id", "level", "key")
    return framed(rows.join(own, "trace_id", "left"), "request")


def framed(rows: DataFrame, kind: str) -> DataFrame:
    """View rows with ``truncated``, ``scenario_sid``, attribution_level, sequence_kind, split and date, from their level and key."""
    split = S.split_of(F.coalesce("key", "trace_id"))
    return rows.select(
        "trace_id", "ops", "outcomes", "offsets", "durations", "parent_pos", "healthy", "n_err_spans", "n_spans", F.lit(False).alias("truncated"), "scenario_hash", F.lit(-1).alias("scenario_sid"),
        "start_ns", F.coalesce("level", F.lit(4)).cast("tinyint").alias("attribution_level"), F.lit(kind).alias("sequence_kind"), split.alias("split"), S.day_of((F.col("start_ns") / 1_000_000).cast("bigint")).alias("date"),
    )


def orientation(rows: DataFrame, ordering: str) -> DataFrame:
    """Links, those whose parent does not follow (end) or precede (start) its child, and their share."""
    link = rows.select(F.posexplode("parent_pos").alias("j", "p")).filter("p >= 0")
    wrong = F.col("p") <= F.col("j") if ordering == "end" else F.col("p") >= F.col("j")
    out = link.agg(F.count(F.lit(1)).alias("links"), F.count_if(wrong).alias("violations"))
    return out.withColumn("rate", F.col("violations") / F.greatest("links", F.lit(1)))


def row_counts(rows: DataFrame) -> DataFrame:
    """Rows per ordering, grain and split, zero where there are none. ``rows``: ordering, grain, split."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(o, g, s) for o in ORDERINGS for g in GRAINS for s in SPLITS], "ordering string, grain string, split string")
    return zero_filled(rows.groupBy("ordering", "grain", "split").agg(F.count(F.lit(1)).alias("rows")), grid, ["ordering", "grain", "split"], "rows")


def zero_filled(counts: DataFrame, grid: DataFrame, keys: list[str], count: str) -> DataFrame:
    return grid.select(*keys).join(counts, keys, "left").select(*keys, F.coalesce(count, F.lit(0)).cast("bigint").alias(count))


def token_counts(rows: DataFrame) -> DataFrame:
    """(op, outcome, n) over the training rows; rows of the end ordering, so each span counts once."""
    token = rows.filter("split = 'train'").select(F.explode(F.arrays_zip("ops", "outcomes")).alias("t")).select(F.col("t.ops").alias("op"), F.col("t.outcomes").alias("outcome"))
    return token.groupBy("op", "outcome").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(tokens: DataFrame, min_count: int) -> DataFrame:
    """The variants: failing or slow tokens that occur often enough."""
    return tokens.filter((F.col("outcome") != S.OK) & (F.col("n") >= min_count)).select("op", "outcome", "n")


def prevalence(rows: DataFrame) -> DataFrame:
    return rows.filter("split = 'train'").groupBy("scenario_hash").agg(F.count(F.lit(1)).alias("n"))


def rc_ops(ops: DataFrame, component: Column) -> DataFrame:
    """Operations of a component: all of a service, or one endpoint."""
    return ops.filter(component)
