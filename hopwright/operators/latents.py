"""Hidden state trajectories: per service a chain load, pool, cache, and per endpoint its health, tick by tick.

A tick's state depends on the one before, so a service is a fold over ticks; services are independent of each other and are
folded in parallel, one Arrow group each. Uniforms are keyed by seed, variable, slot and tick, so any slice can be redrawn.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopwright.functions.draws import keyed_hash

#: The distribution of load (mid, low, high) by intensity day, night, peak.
LOAD_TARGET = ((0.70, 0.15, 0.15), (0.25, 0.70, 0.05), (0.30, 0.0, 0.70))
LOAD, POOL, CACHE, HEALTH = 1, 2, 3, 4
#: What a fault forces: variable and value.
FORCED = {"crash": (HEALTH, 2), "degrade": (HEALTH, 1), "pool_exhaust": (POOL, 2), "cache_flush": (CACHE, 1), "breaker_open": (HEALTH, 2)}


@dataclass(frozen=True)
class Rates:
    """Transition rates per tick."""

    persist: float = 0.95
    tighten: float = 0.05
    exhaust: float = 0.05
    recover: float = 0.1
    cool: float = 0.02
    stay_cold: float = 0.9
    degrade: float = 0.001
    degrade_exhausted: float = 0.05
    heal: float = 0.05
    fail: float = 0.02


def _uniform(seed: int, variable: int, slot: int, ticks: np.ndarray) -> np.ndarray:
    return (keyed_hash(seed, variable, np.full(len(ticks), slot), ticks) >> np.uint64(11)).astype(float) / (1 << 53)


def _pick(u: float, p: tuple[float, ...]) -> int:
    total = 0.0
    for i, x in enumerate(p):
        total += x
        if u < total:
            return i
    return len(p) - 1


def step(load: int, pool: int, cache: int, intensity: int, u: tuple[float, float, float], r: Rates) -> tuple[int, int, int]:
    """The next load, pool and cache of a service."""
    target = LOAD_TARGET[intensity]
    load = _pick(u[0], tuple((1 - r.persist) * target[k] + r.persist * (k == load) for k in range(3)))
    low, high = load == 1, load == 2
    if pool == 0:
        pool = _pick(u[1], (1 - (t := r.tighten if high else r.tighten / 10), t, 0.0))
    elif pool == 1:
        back, out = r.recover * (2 if low else 1), r.exhaust if high else 0.0
        pool = _pick(u[1], (back, 1 - back - out, out))
    else:
        pool = _pick(u[1], (0.0, t := r.recover * (0.3 if high else 1), 1 - t))
    cold = r.stay_cold if cache else (r.cool if high else r.cool / 10)
    return load, pool, int(u[2] >= 1 - cold)


def step_health(health: int, pool: int, u: float, r: Rates) -> int:
    if health == 0:
        return int(u >= 1 - (r.degrade_exhausted if pool == 2 else r.degrade))
    if health == 1:
        back = 0.0 if pool == 2 else r.heal
        return _pick(u, (back, 1 - back - r.fail, r.fail))
    return _pick(u, (0.0, r.heal, 1 - r.heal))


def trajectories(spark: SparkSession, services: DataFrame, first: int, last: int, intensity: list[int], seed: int = 0, rates: Rates = Rates(), forced: list[tuple[int, int, int, int, int]] = ()) -> DataFrame:
    """(tick, variable, slot, value) for ticks in [first, last). ``services``: service (its slot), endpoints (slots).

    ``intensity`` holds the level of each tick; ``forced`` lists (variable, slot, from, to, value), put in force after the draw.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        s, ends = int(pdf["service"].iloc[0]), [int(e) for e in pdf["endpoints"].iloc[0]]
        ticks = np.arange(first, last)
        draws = {v: _uniform(seed, v, s, ticks) for v in (LOAD, POOL, CACHE)}
        own = {e: _uniform(seed, HEALTH, e, ticks) for e in ends}
        held = {(v, slot, t): x for v, slot, a, b, x in forced for t in range(max(a, first), min(b, last)) if (v == HEALTH and slot in own) or (v != HEALTH and slot == s)}
        load = pool = cache = 0
        health = dict.fromkeys(ends, 0)
        rows = []
        for i, t in enumerate(ticks.tolist()):
            load, pool, cache = step(load, pool, cache, intensity[i], (draws[LOAD][i], draws[POOL][i], draws[CACHE][i]), rates)
            load, pool, cache = (held.get((v, s, t), x) for v, x in ((LOAD, load), (POOL, pool), (CACHE, cache)))
            rows += [(t, LOAD, s, load), (t, POOL, s, pool), (t, CACHE, s, cache)]
            for e in ends:
                health[e] = held.get((HEALTH, e, t), step_health(health[e], pool, own[e][i], rates))
                rows.append((t, HEALTH, e, health[e]))
        return pd.DataFrame(rows, columns=["tick", "variable", "slot", "value"])

    return services.groupBy("service").applyInPandas(fold, "tick bigint, variable int, slot int, value int")


def state_at(rows: DataFrame, changes: DataFrame, slot: str, tick: str, state: str) -> DataFrame:
    """``rows`` with the state in force at their tick: the last change of their slot at or before it; rows before any change go.

    Rows and changes are merged in order of the tick and the state is carried on, so no row meets more than its own change.
    """
    key, at, own = F.col(slot).alias("__slot"), F.col(tick).alias("__tick"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("__row")
    left = rows.select(key, at, F.lit(1).alias("__probe"), own, F.lit(None).cast(changes.schema[state].dataType).alias("__state"))
    right = changes.select(key, at, F.lit(0).alias("__probe"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col(state).alias("__state"))
    w = Window.partitionBy("__slot").orderBy("__tick", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    merged = left.unionByName(right).withColumn("__state", F.last("__state", ignorenulls=True).over(w))
    return merged.filter("__probe = 1 AND __state IS NOT NULL").select("__row.*", F.col("__state").alias(state))


def lag1_chain(draws: DataFrame, key: str, at: str, u: str, rows: tuple[tuple[float, ...], ...], start: int = 0) -> DataFrame:
    """``draws`` with ``value``: for each key, in order of ``at``, a state drawn with ``u`` from the row of the state before it.

    A draw maps every state to its next one, and such maps are composed in any grouping. So a key's stretch is folded as a running
    composition: within ranges of ``at`` first, then over the ranges; here one window a key does both.
    """
    n = len(rows)
    pick = lambda row: F.least(sum((F.when(F.col(u) >= sum(row[: k + 1]), 1).otherwise(0) for k in range(n)), F.lit(0)), F.lit(n - 1))
    maps = draws.withColumn("__map", F.array(*(pick(row) for row in rows)))
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    # A state is settled since the last draw that sends every state to one; from there on the maps are few.
    settled = F.size(F.array_distinct("__map")) == 1
    anchored = maps.withColumn("__block", F.sum(settled.cast("int")).over(w))
    own = Window.partitionBy(key, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    first = F.when(F.col("__block") == 0, F.lit(start)).otherwise(F.element_at(F.first("__map").over(own), 1))
    steps = F.collect_list("__map").over(own)
    rest = anchored.withColumns({"__first": first, "__steps": steps})
    inner = F.when(F.col("__block") == 0, F.col("__steps")).otherwise(F.slice("__steps", 2, F.size("__steps")))
    return rest.withColumn("value", F.aggregate(inner, F.col("__first"), lambda s, m: F.get(m, s))).drop("__map", "__block", "__first", "__steps")


def intensity_of(rate_by_hour: list[float], ticks: np.ndarray, tick_s: int = 1) -> list[int]:
    """Day, night (under half the mean rate) or peak (over 1.15 times) by the hour of each tick."""
    rate = np.array(rate_by_hour)[(ticks * tick_s // 3600) % 24]
    return np.where(rate < 0.5, 1, np.where(rate > 1.15, 2, 0)).tolist()


def forcings(faults: DataFrame) -> list[tuple[int, int, int, int, int]]:
    """Faults (kind, slot, start_s, end_s) as forced intervals of whole ticks: the start rounded down, the end up."""
    rows = faults.select("kind", "slot", F.floor("start_s").alias("a"), F.ceil("end_s").alias("b")).collect()  # a handful, from the configuration
    return [(FORCED[r.kind][0], r.slot, int(r.a), int(r.b), FORCED[r.kind][1]) for r in rows]
