"""Sessions by gap, ordered sequence rows, labels and the loss of recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwright.storage import Rounds

GAP_MS = 30 * 60 * 1000
#: Phases of a sequence against a fault.
PRE, POST, STRADDLE, NO_PHASE = 0, 1, 2, -1


def with_runs(df: DataFrame, keys: list[str], at: str, tie: str, gap: int = GAP_MS) -> DataFrame:
    """``df`` with the number of its run per key: a new run starts after a pause longer than ``gap``; a pause of just that stays."""
    order = Window.partitionBy(*keys).orderBy(at, tie)
    pause = F.col(at) - F.lag(at).over(order)
    marked = df.withColumn("__new", F.when(pause.isNull() | (pause > gap), 1).otherwise(0))
    return marked.withColumn("run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("__new")


def run_id(keys: list[Column], start_ms: Column) -> Column:
    """A run's id: hash of its key and the minute it starts in."""
    return F.md5(F.concat_ws("|", *(k.cast("string") for k in keys), F.floor(start_ms / 60000).cast("string")).cast("binary"))


def ordered(items: Column) -> Column:
    """Aggregate: the structs of a group in order; sort fields come first in them."""
    return F.array_sort(F.collect_list(items))


def view_rows(spans: DataFrame, keys: list[str], ordering: str = "end") -> DataFrame:
    """One row per key with five parallel arrays. ``spans``: span_id, op, outcome, start_ms, end_ms, parent, depth and the keys.

    Ties on the clock go by containment, then by depth, then by span id.
    """
    sort = (
        [F.col("end_ms"), -F.col("start_ms"), -F.col("depth"), F.col("span_id")] if ordering == "end" else [F.col("start_ms"), -F.col("end_ms"), F.col("depth"), F.col("span_id")]
    )
    item = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(sort)), "op", "outcome", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), "parent", F.col("span_id").alias("id"))
    rows = spans.groupBy(*keys).agg(ordered(item).alias("m"), F.min("start_ms").alias("t0"))
    ids = F.transform("m", lambda x: x["id"])
    rows = rows.withColumn("ids", ids)
    place = lambda x: F.when(x["parent"].isNull(), -1).otherwise(F.array_position("ids", x["parent"]).cast("int") - 1)
    rows = rows.withColumns(
        {
            "ops": F.transform("m", lambda x: x["op"]),
            "outcomes": F.transform("m", lambda x: x["outcome"]),
            "offsets": F.transform("m", lambda x: (x["s"] - F.col("t0")) * 1_000_000),
            "durations": F.transform("m", lambda x: F.greatest(F.lit(0), x["e"] - x["s"]) * 1_000_000),
            "parent_pos": F.transform("m", place),
        }
    )
    pairs = F.array_distinct(F.zip_with("parent_pos", "ops", lambda p, o: F.struct(F.when(p >= 0, F.get("ops", p)).otherwise(-1).alias("a"), o.alias("b"))))
    n_err = F.size(F.filter("outcomes", lambda o: o.isin(1, 2, 3)))
    return rows.select(
        *keys, "ops", "outcomes", "offsets", "durations", "parent_pos", (n_err == 0).alias("healthy"), n_err.alias("n_err_spans"), F.size("m").alias("n_spans"),
        (F.col("t0") * 1_000_000).alias("start_ns"), pair_hash(pairs).alias("scenario_hash"),
    )


def pair_hash(pairs: Column) -> Column:
    """sha1 of distinct (a, b) pairs in numeric order, written 'a,b;a,b'."""
    text = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat_ws(",", p["a"].cast("string"), p["b"].cast("string"))), ";")
    return F.sha1(text.cast("binary"))


def phase(start: Column, end: Column, low: Column, high: Column) -> Column:
    """A sequence against the fault interval [low, high): from its end on none, before it pre, inside it post, else straddling."""
    return F.when(start >= high, NO_PHASE).when(end < low, PRE).when((start >= low) & (end < high), POST).otherwise(STRADDLE)


def fault_labels(rows: DataFrame, faults: DataFrame, epoch_ms: int = 0) -> DataFrame:
    """One row per sequence and fault: phase, the positions of root-cause operations in both orderings, and whether any of them failed.

    ``rows``: trace_id, start_ms, end_ms, ops_end, outcomes_end, ops_start; ``faults``: fault_index, start_s, end_s (from the window's
    start) and causes, a handful from the configuration, which every sequence meets.
    """
    met = rows.crossJoin(F.broadcast(faults))
    at = phase(F.col("start_ms") - epoch_ms, F.col("end_ms") - epoch_ms, F.col("start_s") * 1000, F.col("end_s") * 1000)
    end = root_cause_positions(F.col("ops_end"), F.col("causes"))
    took = F.exists(end, lambda i: F.get("outcomes_end", i) != 0)
    return met.select(
        "trace_id", "fault_index", at.alias("phase"), end.alias("rc_positions_end"), root_cause_positions(F.col("ops_start"), F.col("causes")).alias("rc_positions_start"), took.alias("rc_took")
    )


def root_cause_positions(ops: Column, causes: Column) -> Column:
    return F.filter(F.transform(ops, lambda o, i: F.when(F.array_contains(causes, o), i)), lambda i: i.isNotNull())


def _climbed(links: DataFrame, most: int) -> DataFrame:
    """(row, id, up, depth, least): each node's ancestor as far up as is known, the steps to it, and the least id on the way. Pointer
    doubling: a round doubles the steps, so rounds are the logarithm of the depth; nodes still below another one after ``most`` steps
    lead into a cycle."""
    rounds = Rounds(links.sparkSession, "depths")
    start = F.when(F.col("up").isNull(), 0).otherwise(1)
    state = rounds.settle(links.select("row", "id", "up", start.alias("depth"), F.least("id", "up").alias("least")))
    steps = 1
    while steps <= most and not state.filter("up is not null").isEmpty():
        above = state.select(F.col("row").alias("r2"), F.col("id").alias("i2"), F.col("up").alias("u2"), F.col("depth").alias("d2"), F.col("least").alias("l2"))
        met = state.join(above, (F.col("row") == F.col("r2")) & (F.col("up") == F.col("i2")), "left")
        state = rounds.settle(met.select("row", "id", F.col("u2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.least("least", "l2").alias("least")))
        steps *= 2
    return state


def depths(links: DataFrame) -> DataFrame:
    """Depth of each (row, id) under its parent link; roots and parents outside the row are 0. A cycle is cut at the link to its least
    id: the node that names it as parent is a root. Each round of the climb is written, so plans stay small."""
    rounds = Rounds(links.sparkSession, "links")
    known = links.select(F.col("row").alias("r2"), F.col("id").alias("i2"))
    inside = links.join(known, (F.col("row") == F.col("r2")) & (F.col("parent") == F.col("i2")), "left")
    up = rounds.settle(inside.select("row", "id", F.col("i2").alias("up")))
    most = up.groupBy("row").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    state = _climbed(up, most)
    endless = state.filter("up is not null")
    if not endless.isEmpty():
        # After as many steps as there are nodes every pointer is inside a cycle, and every node of one is pointed at.
        on_cycle = endless.select("row", F.col("up").alias("id")).distinct()
        least = state.join(on_cycle, ["row", "id"], "left_semi").select("row", "id", F.col("least").alias("cut"))
        up = rounds.settle(up.join(least, ["row", "id"], "left").select("row", "id", F.when(~F.col("up").eqNullSafe(F.col("cut")) | F.col("cut").isNull(), F.col("up")).alias("up")))
        state = _climbed(up, most)
    return state.select("row", "id", "depth")


def merge_rate(members: DataFrame, truth: str, found: str) -> DataFrame:
    """Sequences, those that hold members of more than one true session, and their share."""
    per = members.filter(F.col(truth).isNotNull()).groupBy(found).agg(F.countDistinct(truth).alias("n"))
    every = members.select(found).distinct().join(per, found, "left")
    out = every.agg(F.count(F.lit(1)).alias("sequences"), F.count_if(F.col("n") > 1).alias("merged"))
    return out.withColumn("merge_rate", F.col("merged") / F.greatest("sequences", F.lit(1)))


def recovery(members: DataFrame, truth: str, found: str) -> DataFrame:
    """For each true session its best sequence: most common members, on ties the smallest id; with the Jaccard index."""
    common = members.groupBy(truth, found).agg(F.count(F.lit(1)).alias("c"))
    n = members.groupBy(truth).agg(F.count(F.lit(1)).alias("n"))
    s = members.groupBy(found).agg(F.count(F.lit(1)).alias("s"))
    best = common.groupBy(truth).agg(F.min(F.struct((-F.col("c")).alias("c"), F.col(found).alias("f"))).alias("b"), F.count(F.lit(1)).alias("pieces"))
    best = best.select(truth, (-F.col("b.c")).alias("c"), F.col("b.f").alias(found), "pieces")
    return best.join(n, truth).join(s, found).withColumn("jaccard", F.col("c") / (F.col("n") + F.col("s") - F.col("c")))
