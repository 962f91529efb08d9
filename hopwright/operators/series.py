"""Time series: scrape grid, samples, change log, sampling loss; and the realism statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(start: Column, end: Column, step: int) -> Column:
    """The multiples of ``step`` in [start, end)."""
    first = start + F.pmod(-start, F.lit(step))
    return F.when(first < end, F.sequence(first, end - 1, F.lit(step))).otherwise(F.array().cast("array<bigint>"))


SCRAPE_S = 30
#: Metric families of the groups that a cluster exports.
FAMILIES = {"intensity": "traffic_intensity", "load": "service_load", "pool": "pool_state", "health": "endpoint_health"}


def scrape_ticks(tick_s: int, shard_ticks: int, scrape_s: int = SCRAPE_S) -> int:
    """Ticks between two scrapes; a period that the tick, or a shard that the scrapes, don't divide is refused."""
    if scrape_s % tick_s:
        raise ValueError(f"a scrape period of {scrape_s} s is no multiple of the tick of {tick_s} s")
    if shard_ticks % (scrape_s // tick_s):
        raise ValueError(f"a shard of {shard_ticks} ticks is no multiple of the {scrape_s // tick_s} ticks between scrapes")
    return scrape_s // tick_s


def catalogue(services: DataFrame, ops: DataFrame, exposed: list[str]) -> DataFrame:
    """The series of a variant: family, service, endpoint, group, slot and the stem of their tokens, in order of the first three with
    null as ''. One for intensity, one a service for load and pool, one an operation for health. ``services``: index, name, kind;
    ``ops``: id, service, name, kind."""
    spark = services.sparkSession
    backend = services.filter("kind <> 2")
    out = spark.createDataFrame([], "family string, service string, endpoint string, `group` string, slot int, stem string")
    for group in [g for g in FAMILIES if g in exposed]:
        family = F.lit(FAMILIES[group])
        if group == "intensity":
            rows = spark.range(1).select(family.alias("family"), F.lit(None).cast("string").alias("service"), F.lit(None).cast("string").alias("endpoint"), F.lit(group).alias("group"), F.lit(0).alias("slot"), F.lit("state:intensity").alias("stem"))
        elif group == "health":
            named = ops.filter("kind <> 2").join(backend.select(F.col("index").alias("service"), F.col("name").alias("service_name")), "service")
            rows = named.select(family.alias("family"), F.col("service_name").alias("service"), F.col("name").alias("endpoint"), F.lit(group).alias("group"), F.col("id").alias("slot"), F.concat(F.lit("state:health:"), F.col("id").cast("string")).alias("stem"))
        else:
            rows = backend.select(family.alias("family"), F.col("name").alias("service"), F.lit(None).cast("string").alias("endpoint"), F.lit(group).alias("group"), F.col("index").alias("slot"), F.concat(F.lit(f"state:{group}:"), F.col("index").cast("string")).alias("stem"))
        out = out.unionByName(rows)
    return out.orderBy("family", F.coalesce("service", F.lit("")), F.coalesce("endpoint", F.lit("")))


def grid_samples(states: DataFrame, keys: list[str], at: str, value: str, every: int) -> DataFrame:
    """The levels of dense states (a row a tick) at the scrapes: those whose tick is on the grid."""
    return states.filter(F.col(at) % every == 0).select(*keys, at, value)


def change_log(states: DataFrame, keys: list[str], at: str, value: str, every: int, end: int, group: str, exposed: list[str]) -> DataFrame:
    """Every change with ``exposed`` and ``visible``; the first state is held against the nominal 0."""
    log = visible_changes(changes(states, keys, at, value, F.lit(0)), keys, at, value, every, end)
    return log.withColumn("exposed", F.col(group).isin(*exposed) if exposed else F.lit(False))


def changes(states: DataFrame, keys: list[str], at: str, value: str, nominal: Column | None = None) -> DataFrame:
    """Rows at which the value differs from the one before; the first row is held against the nominal value if there is one."""
    w = Window.partitionBy(*keys).orderBy(at)
    before = F.lag(value).over(w)
    previous = F.coalesce(before, nominal) if nominal is not None else before
    return states.withColumn("previous", previous).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def samples(states: DataFrame, keys: list[str], at: str, value: str, start: Column | int, end: Column | int, step: int) -> DataFrame:
    """The level of each series at each instant of the grid in [start, end): the last value at or before it.

    A value holds from its change to the next one, so each row gives the instants in that stretch: no instants are joined and nothing is
    carried through a window but the next change.
    """
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    until = F.coalesce(F.lead(at).over(Window.partitionBy(*keys).orderBy(at)), end)
    low, high = F.greatest(F.col(at), start), F.least(until, end)
    instants = grid(low.cast("bigint"), high.cast("bigint"), step)
    return states.withColumn("__t", instants).select(*keys, F.explode("__t").alias(at), F.col(value))


def visible_changes(log: DataFrame, keys: list[str], at: str, value: str, step: int, end: int) -> DataFrame:
    """The change log with ``visible``: whether the value at the next scrape is still the new one; null after the last scrape."""
    w = Window.partitionBy(*keys).orderBy(at)
    scrape = F.col(at) + F.pmod(-F.col(at), F.lit(step))
    following = F.lead(at).over(w)
    # Only changes up to the scrape can replace the value; what returns to it by then is visible again.
    final = log.withColumns({"scrape": scrape, "__next": following})
    w2 = Window.partitionBy(*keys, "scrape").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return final.withColumn("at_scrape", F.last(value).over(w2)).withColumn("visible", F.when(F.col("scrape") < end, F.col("at_scrape") == F.col(value))).drop("__next", "at_scrape")


def sampling_loss(log: DataFrame, group: str) -> DataFrame:
    """Changes, invisible and unresolved ones per group; the share leaves unresolved ones out."""
    out = log.groupBy(group).agg(F.count(F.lit(1)).alias("changes"), F.count_if(~F.col("visible")).alias("invisible"), F.count_if(F.col("visible").isNull()).alias("unresolved"))
    return out.withColumn("share_invisible", F.try_divide(F.col("invisible").cast("double"), (F.col("changes") - F.col("unresolved")).cast("double")))


def exact_quantiles(df: DataFrame, group: str, value: str, at: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Quantiles with linear interpolation by group, and its size.

    Values are ranked by ranges, not in one task a group: rows are dealt by ranges of (group, value), a range's ranks follow from the
    sizes of those before it, and only the rows next to a quantile's place are gathered.
    """
    from hopwright.operators.scoring import running

    rows = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy("g").agg(F.sum("n").alias("size"))
    ranked = running(rows, [F.asc("g"), F.asc("v")], {"n": "before"})
    first = ranked.groupBy("g").agg(F.min("before").alias("start"))
    wanted = sizes.join(first, sizes["g"].eqNullSafe(first["g"])).select(sizes["g"].alias("g"), "size", "start", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(at)))).alias("p"))
    wanted = wanted.select("g", "size", "start", "p.i", (F.col("p.q") * (F.col("size") - 1)).alias("place"))
    near = ranked.join(wanted.withColumnRenamed("g", "g2"), F.col("g").eqNullSafe(F.col("g2")))
    low, here = F.floor("place"), F.col("before") - F.col("start")
    holds = lambda k: (here <= k) & (k < here + F.col("n"))
    near = near.filter(holds(low) | holds(F.ceil("place")))
    found = near.groupBy("g", "size", "i", "place").agg(F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(F.ceil("place")), F.col("v"))).alias("b"))
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))
    out = found.groupBy("g", "size").agg(*(F.max(F.when(F.col("i") == i, value_at)).alias(f"p{round(q * 100)}") for i, q in enumerate(at)))
    return out.select(F.col("g").alias(group), *(f"p{round(q * 100)}" for q in at), F.col("size").alias("n"))


def gated_rate(df: DataFrame, group: str, bad: Column, least: int = 200) -> DataFrame:
    """Share of bad rows in the groups with enough rows."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(bad.cast("double")).alias("rate")).filter(F.col("n") >= least)


def fan_out(df: DataFrame, parent: str) -> DataFrame:
    known = df.filter(F.col(parent).isNotNull())
    return known.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(parent).alias("parents")).withColumn("fan_out", F.try_divide(F.col("rows").cast("double"), F.col("parents").cast("double")))


def depth_pmf(df: DataFrame, request: str, layer: str, levels: int) -> DataFrame:
    """Distribution of the deepest layer of a request, capped at ``levels``."""
    deep = df.groupBy(request).agg(F.max(layer).alias("m")).select(F.least("m", F.lit(levels)).cast("int").alias("depth"))
    counts = deep.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("depth", "n", (F.col("n") / F.col("all")).alias("share"))


def response_gaps(df: DataFrame, keys: list[str], at: str, least: float) -> DataFrame:
    """Pauses between consecutive rows of a key, equal times dropped, longer than ``least`` only."""
    w = Window.partitionBy(*keys).orderBy(at)
    return df.select(*keys, at).distinct().withColumn("gap", F.col(at) - F.lag(at).over(w)).filter(F.col("gap") > least)


def headline(df: DataFrame, group: str, value: str) -> DataFrame:
    """Size, mean, sample deviation and deciles of a value by group."""
    spread = df.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    quantiles = exact_quantiles(df, group, value, (0.1, 0.5, 0.9)).withColumnRenamed(group, "__g")
    return spread.join(quantiles, F.col(group).eqNullSafe(F.col("__g"))).select(group, "n", "mean", "std", "p10", "p50", "p90")


def mean_retries(df: DataFrame, attempt: str) -> DataFrame:
    """Retries to a first attempt."""
    return df.agg(F.try_divide(F.count_if(F.col(attempt) > 0).cast("double"), F.count_if(F.col(attempt) == 0).cast("double")).alias("mean_retries"))


def nominal(spans: DataFrame) -> DataFrame:
    """Spans whose endpoint, pool and cache were nominal."""
    return spans.filter("state_health = 0 AND state_pool = 0 AND state_cache = 0")


def realism(spans: DataFrame, ops: DataFrame, levels: int, least: int = 200) -> dict[str, DataFrame]:
    """The statistics that a corpus is held against its constants with, from true spans and ``ops`` (id, kind, depth, leaf)."""
    named = spans.join(ops.select(F.col("id").alias("op"), "kind", "depth", "leaf"), "op")
    failed = F.col("outcome").isin(1, 2, 3)
    plain = nominal(named)
    return {
        "latency": exact_quantiles(plain, "kind", "own_ms"), "error_rates": gated_rate(plain, "kind", failed, least), "leaf_error_rates": gated_rate(plain.filter("leaf"), "kind", failed, least),
        "retries": mean_retries(named.filter("NOT is_edge"), "attempt"), "fan_out": fan_out(named.filter("attempt = 0"), "parent"), "depths": depth_pmf(named.filter("kind = 1"), "req_gid", "depth", levels),
    }


def tolerance_ok(measured: float | None, constant: float, absolute: float = 0.01, relative: float = 0.1) -> bool | None:
    """Whether a measurement is close enough; against a constant of zero only the absolute bound counts, and nothing measured is no
    verdict."""
    if measured is None:
        return None
    return abs(measured - constant) <= (absolute if constant == 0 else max(absolute, relative * abs(constant)))
