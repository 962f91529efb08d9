"""Traffic of a simulated system: arrivals, journeys and request trees, and the records that they leave.

Every draw is keyed by seed, domain and coordinates, so any part can be made again on its own. Arrivals are expressions over a range of
ticks. Sessions are independent of each other; those of one shard (a stretch of arrival ticks) meet the states they can live to see and
are evaluated together, operation by operation, on arrays. Records are selections from the hops and clients that this gives.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopwright import config as C
from hopwright.config import Constants
from hopwright.functions import draws as D
from hopwright.functions import ids, spans
from hopwright.operators import feed, latents
from hopwright.operators import mechanism as M
from hopwright.topology import CLIENT, CLIENT_NETS, EDGE, EXTERNAL, TIERS, System

#: Domains of draws, and what is drawn in them.
SESSION, HOP, EMIT, SKEW, DEFECT, CLIENTS, ARRIVAL = 3, 5, 6, 7, 8, 9, 2
SCENARIO, NET, AUTH, LOGIN, MOMENT, GAP = range(6)
CLASS, OWN, HIT, RHO, RETRY, POD, STATUS, CALL = range(8)
#: Pauses and the delay until the client notes an answer.
CLIENT_PAUSE_MS, CLIENT_DELAY_MS, MOST_GAP_S = 1000, 40, 3600.0
OUTCOMES = ("ok", "4xx", "5xx", "err", "slow", "absent")
ABSENT = 5
#: Arrivals of a tick are drawn in parts of at most this mean.
PART = 4.0
METHODS = ("GET", "POST", "POST", "GET", "PUT", "DELETE")
MODULES = ("OSA", "ORD", "CAT", "USR", "PAY", "AUTH")
FILLER = "context payload " * 8


@dataclass
class Plant:
    """What a simulation runs on: the system, its configuration and constants, latencies, and the seed."""

    system: System
    config: dict
    constants: Constants
    latency: M.Latency
    seed: int

    @property
    def epoch_ms(self) -> int:
        return C.epoch_ms(self.config["run"]["window"]["start"])

    @property
    def tick_s(self) -> int:
        return self.config["run"]["tick_s"]

    @property
    def ticks(self) -> int:
        return round(C.window_seconds(self.config) / self.tick_s)

    @property
    def gap_knots(self) -> list[float]:
        q = [self.constants[f"session.step_gap_quantiles.{p}"] for p in C.QUANTILES]
        return [0.5, *q, min(3 * q[3], MOST_GAP_S)]

    def profile(self, tick: Column) -> Column:
        """The multiplier of the base rate at a tick: hour of the day times day of the week, both by the window's start."""
        return spans.profile(F.lit(self.epoch_ms) + tick * (self.tick_s * 1000), self.constants["daily_profile"], self.constants["weekday"])


def intensity(profile: Column) -> Column:
    """Day, night (under half the base rate) or peak (over 1.15 times)."""
    return F.when(profile < 0.5, 1).when(profile > 1.15, 2).otherwise(0)


def arrivals(spark: SparkSession, plant: Plant) -> DataFrame:
    """One row per session: gid, shard, arrival_tick, arrival_ms, scenario, net, auth, logged_in. A session's id is its tick and its
    number there."""
    ticks = spark.range(0, plant.ticks).select(F.col("id").alias("arrival_tick"))
    mean = plant.profile(F.col("arrival_tick")) * (plant.config["run"]["base_rps"] * plant.tick_s)
    most = plant.config["run"]["base_rps"] * plant.tick_s * max(plant.constants["daily_profile"]) * max(plant.constants["weekday"])
    parts = max(1, math.ceil(most / PART))
    u = lambda j: D.uniform(plant.seed, ARRIVAL, F.col("arrival_tick"), F.lit(j))
    count = sum((poisson_count(u(j), mean / parts) for j in range(parts)), F.lit(0))
    each = ticks.withColumn("n", count).filter("n > 0").select("arrival_tick", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    c, gid = plant.constants, F.col("gid")
    draw = lambda what: D.uniform(plant.seed, SESSION, gid, F.lit(what))
    scenarios = np.cumsum([s.weight for s in plant.system.scenarios]).tolist()
    return each.withColumn("gid", F.shiftleft("arrival_tick", 20).bitwiseOR(F.col("k").cast("bigint"))).select(
        "gid", F.floor(F.col("arrival_tick") / plant.config["run"]["shard_ticks"]).alias("shard"), "arrival_tick",
        (F.col("arrival_tick") * (plant.tick_s * 1000) + F.floor(draw(MOMENT) * plant.tick_s * 1000)).cast("bigint").alias("arrival_ms"), D.categorical(draw(SCENARIO), scenarios).alias("scenario"),
        (draw(NET) < c["client.net_flaky_share"]).cast("int").alias("net"), (draw(AUTH) < c["client.auth_expired_share"]).cast("int").alias("auth"), (draw(LOGIN) < c["client.logged_in_share"]).alias("logged_in"),
    )


def poisson_count(u: Column, mean: Column, terms: int = 40) -> Column:
    """A Poisson count by inversion with a mean that is a column."""
    steps = F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda k: k.cast("double"))
    start = F.struct(F.lit(0).alias("n"), F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"))
    more = lambda s, k: F.struct((s["n"] + (u >= s["cdf"]).cast("int")).alias("n"), (s["p"] * mean / k).alias("p"), (s["cdf"] + s["p"] * mean / k).alias("cdf"))
    return F.aggregate(steps, start, more, lambda s: s["n"])


def rates(plant: Plant) -> latents.Rates:
    """The transition rates of the constants."""
    c = lambda k: plant.constants[f"state_dynamics.{k}"]
    return latents.Rates(
        c("load_persist"), c("pool_tight_given_high"), c("pool_exhausted_given_high"), c("pool_recover"), c("cache_cold_given_high"), c("cache_persist_cold"), c("health_degraded_base"),
        c("health_degraded_given_exhausted"), c("health_recover"), c("health_failed_given_degraded"),
    )


def faults(plant: Plant) -> list[dict]:
    """Scheduled faults with the operations they cause and the slots they force."""
    out, system = [], plant.system
    inner = [s for s in system.services if s.kind not in (EDGE, CLIENT, EXTERNAL)]
    outer = [s for s in system.services if s.kind == EXTERNAL]
    for i, f in enumerate(plant.config["schedules"]["faults"]):
        kind, index, endpoint = C.component(f["component"], plant.config["counts"], plant.config["topology"]["external_services"])
        service = system.services[0] if kind == "bff" else (inner if kind == "service" else outer)[index]
        ops = [o.id for o in system.ops if o.service == service.index]
        ops = ops if endpoint is None else [ops[endpoint]]
        variable, value = latents.FORCED[f["kind"]]
        out.append({"fault_index": i, "start_s": float(f["start_s"]), "end_s": float(f["end_s"]), "causes": ops, "variable": variable, "slots": ops if variable == latents.HEALTH else [service.index], "value": value})
    return out


def states(spark: SparkSession, plant: Plant) -> DataFrame:
    """(tick, variable, slot, value) of every hidden state in the window, faults included."""
    system = plant.system
    rows = [(s.index, [o.id for o in system.ops if o.service == s.index]) for s in system.services if s.kind != CLIENT]
    forced = [(f["variable"], slot, math.floor(f["start_s"] / plant.tick_s), math.ceil(f["end_s"] / plant.tick_s), f["value"]) for f in faults(plant) for slot in f["slots"]]
    levels = [r.i for r in spark.range(0, plant.ticks).select("id", intensity(plant.profile(F.col("id"))).alias("i")).orderBy("id").collect()]  # one number a tick
    return latents.trajectories(spark, spark.createDataFrame(rows, "service int, endpoints array<int>"), 0, plant.ticks, levels, plant.seed, rates(plant), forced)


def states_by_shard(plant: Plant, trajectory: DataFrame) -> DataFrame:
    """What a shard's sessions can live to see: the state at the start of each stretch and every change, in the shards from which a
    journey can last until then. A journey's pauses are bounded, so is how many shards that are."""
    ticks = plant.config["run"]["shard_ticks"]
    longest = max(len(s.steps) * (s.max_retries + 1) for s in plant.system.scenarios) * (MOST_GAP_S + 600)
    shards = math.ceil(longest / plant.tick_s / ticks)
    w = Window.partitionBy("variable", "slot", F.floor(F.col("tick") / ticks)).orderBy("tick")
    before = F.lag("value").over(w)
    changes = trajectory.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col("__before") != F.col("value"))).drop("__before")
    own = F.floor(F.col("tick") / ticks)
    return changes.withColumn("shard", F.explode(F.sequence(F.greatest(F.lit(0), own - shards), own)))


class _States:
    """Values of hidden states at ticks, from their changes; beyond the last one it holds."""

    def __init__(self, rows: pd.DataFrame):
        self.by = {k: (g["tick"].to_numpy(), g["value"].to_numpy()) for k, g in rows.sort_values("tick").groupby(["variable", "slot"])}

    def at(self, variable: int, slot: int, ticks: np.ndarray) -> np.ndarray:
        found = self.by.get((variable, slot))
        if found is None:
            return np.zeros(len(ticks), np.int64)
        return found[1][np.maximum(np.searchsorted(found[0], ticks, side="right") - 1, 0)].astype(np.int64)


class Evaluator:
    """Request trees of one edge operation for many requests at once."""

    def __init__(self, plant: Plant, force: dict[str, str] | None = None):
        """``force`` holds variables of the mechanism (invocations, attempts, finals of backend operations) at a value."""
        self.plant, self.system, self.force = plant, plant.system, force or {}
        rows = M.class_rows(plant.constants, plant.config["mechanism"]["error_rate_multiplier"])
        self.class_cdf = {t: np.cumsum(r, axis=-1) for t, r in rows.items()}
        self.reached_cdf = np.array([np.ones(4), *(np.cumsum(M.PROPAGATION[c]) for c in M.CLASSES[1:])])
        self.retries, self.again = plant.config["endpoints"]["retry"], plant.constants["retry.p_retry_5xx"]

    def _invocation(self, op: int) -> bool | None:
        """Whether an operation is held invoked, or not; None where nothing says so. A held outcome takes an invocation."""
        if (own := self.force.get(f"I:{op}")) is not None:
            return own == "present"
        return True if any(k.split(":")[:2] in (["F", str(op)], ["A", str(op)]) and x != "absent" for k, x in self.force.items()) else None

    @staticmethod
    def _pick(u: np.ndarray, cdf: np.ndarray) -> np.ndarray:
        return np.minimum((u[:, None] >= cdf).sum(axis=1), cdf.shape[1] - 1)

    def trees(self, edge: int, requests: pd.DataFrame, held: _States, mask: list[str]) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
        """Outcome and end of each request, and a row for each attempt of each hop. ``requests``: req_gid, gid, start_ms, tick, auth."""
        system, plant, n = self.system, self.plant, len(requests)
        req, tick, start = (requests[c].to_numpy() for c in ("req_gid", "tick", "start_ms"))
        draw = lambda index, what, k=0: D.uniforms(plant.seed, HOP, req, np.full(n, index), np.full(n, what), np.full(n, k))
        order = system.reach(edge)
        state = {v: {"health": held.at(latents.HEALTH, v, tick), **{g: held.at(x, system.ops[v].service, tick) for g, x in (("pool", latents.POOL), ("cache", latents.CACHE), ("load", latents.LOAD))}} for v in order}
        # From the top: who calls whom. The first caller whose call goes through is the parent.
        parent = {edge: np.full(n, -1)}
        here = {edge: np.ones(n, bool)}
        for v in order[1:]:
            parent[v] = np.full(n, -1)
            for c in system.callers_of[v]:
                if c.caller not in here:
                    continue
                made = here[c.caller] & (draw(c.index, CALL) < c.p_call)
                if c.cached:
                    made &= (state[c.caller]["cache"] == 1) | (draw(c.index, HIT) >= c.p_hit)
                parent[v] = np.where(made & (parent[v] < 0), c.caller, parent[v])
            if (set_ := self._invocation(v)) is not None:
                callers = [c.caller for c in system.callers_of[v] if c.caller in here]
                parent[v] = np.where(parent[v] < 0, next(iter(callers), -1), parent[v]) if set_ else np.full(n, -1)
            here[v] = parent[v] >= 0
        # From the bottom: what each attempt comes to and how long it takes.
        final, total, attempts = {}, {}, {}
        for v in reversed(order):
            op, own = system.ops[v], system.calls_of[v]
            worst, waited = np.zeros(n, int), np.zeros(n)
            for c in own:
                waited += total[c.callee] * (parent[c.callee] == v)
                if c.critical:
                    bad = np.where(final[c.callee] < 4, final[c.callee], 0)
                    worst = np.maximum(worst, np.where(draw(c.index, RHO) < c.rho, bad, 0))
            s = state[v]
            cold = (s["cache"] == 1) & any(c.cached for c in own)
            slower = plant.latency.multiplier(s["health"], s["pool"], cold.astype(int))
            allowed = np.array([x == "ok" or x in (mask if op.kind == EDGE else plant.config["endpoints"]["repertoire"]) for x in OUTCOMES])
            made, fin, sum_s, attempts[v] = here[v].copy(), np.full(n, ABSENT), np.zeros(n), []
            for k in range(1 if op.kind == EDGE else self.retries["max_retries"] + 1):
                if k:
                    made = made & np.isin(last, [OUTCOMES.index(x) for x in self.retries["retry_on"]]) & (draw(v, RETRY, k) < self.again)
                if not made.any():
                    break
                u = draw(v, CLASS, k)
                cls = self._pick(u, np.where((worst > 0)[:, None], self.reached_cdf[worst], self.class_cdf[TIERS[op.kind]][s["health"], s["pool"]]))
                if op.kind == EDGE:
                    cls = np.where((requests["auth"].to_numpy() == 1) & (draw(v, STATUS, k + 8) < M.EDGE_4XX_ON_EXPIRED), 1, cls)
                cls = np.where(allowed[cls], cls, 0)
                own_s = plant.latency.own(v, draw(v, OWN, k)) * slower
                all_s = own_s + (waited if k == 0 else M.RETRY_PAUSE_S)
                limit = plant.latency.threshold[v]
                if k == 0 and (end := self.force.get(f"F:{v}")) not in (None, "absent"):
                    # A final held at a class takes as long as that class allows.
                    all_s = np.maximum(all_s, limit * 1.0001) if end == "slow" else np.minimum(all_s, limit)
                last = np.where((cls == 0) & allowed[4] & (all_s > limit), 4, cls)
                if (set_ := self.force.get(f"A:{v}:{k}")) is not None:
                    last, made = np.full(n, OUTCOMES.index(set_)), here[v] & (set_ != "absent")
                attempts[v].append((made.copy(), last, own_s, all_s, sum_s.copy()))
                fin, sum_s = np.where(made, last, fin), sum_s + np.where(made, all_s, 0.0)
                last = np.where(made, last, ABSENT)
            if (set_ := self.force.get(f"F:{v}")) is not None:
                fin = np.where(here[v], OUTCOMES.index(set_), ABSENT)
            final[v], total[v] = fin, sum_s
        # From the top again: callees one after the other once half of the caller's own time is over.
        begin = {edge: start.astype(float)}
        for v in order:
            if not attempts[v]:
                continue
            cursor = begin[v] + 500.0 * attempts[v][0][2]
            for c in system.calls_of[v]:
                mine = parent[c.callee] == v
                begin[c.callee] = np.where(mine, cursor, begin.get(c.callee, np.zeros(n)))
                cursor = cursor + np.where(mine, total[c.callee] * 1000, 0.0)
        rows = []
        for v in order:
            pods, services = max(1, len(system.services[system.ops[v].service].pods)), system.ops[v].service
            for k, (made, outcome, own_s, all_s, passed) in enumerate(attempts[v]):
                m = np.flatnonzero(made)
                at = np.rint(begin[v] + passed * 1000).astype(np.int64)[m]
                length = np.rint(all_s[m] * 1000).astype(np.int64)
                status = np.array(spans.STATUSES)[outcome[m], (draw(v, STATUS, k)[m] * 5).astype(int)]
                rows.append(pd.DataFrame({
                    "req_gid": req[m], "gid": requests["gid"].to_numpy()[m], "op": v, "attempt": k, "parent_op": parent[v][m], "service": services, "pod": (draw(v, POD, k)[m] * pods).astype(int), "outcome": outcome[m],
                    "status": status, "start_ms": at, "end_ms": at + length, "duration_ms": length, "own_ms": np.rint(own_s[m] * 1000).astype(np.int64), "is_edge": v == edge, "tick": tick[m],
                    **{f"state_{g}": x[m] for g, x in state[v].items()},
                }))
        return final[edge], start + np.rint(total[edge] * 1000).astype(np.int64), pd.concat(rows, ignore_index=True)


HOPS = "shard long, req_gid long, gid long, op int, attempt int, parent_op int, service int, pod int, outcome int, status int, start_ms long, end_ms long, duration_ms long, own_ms long, is_edge boolean, tick long, state_health int, state_pool int, state_cache int, state_load int"
CLIENT_COLUMNS = "step int, client_op int, tagged boolean, sampled boolean"


def journeys(sessions: pd.DataFrame, changes: pd.DataFrame, evaluator: Evaluator) -> pd.DataFrame:
    """Hops and client rows (``client_op`` set) of a shard's sessions: steps in lockstep, a failed step ends its journey."""
    plant, system = evaluator.plant, evaluator.system
    held, out = _States(changes), []
    s = sessions.reset_index(drop=True)
    clock, going = s["arrival_ms"].to_numpy().astype(np.int64), np.ones(len(s), bool)
    steps = np.array([len(x.steps) for x in system.scenarios])[s["scenario"]]
    for step in range(max(len(x.steps) for x in system.scenarios)):
        going &= steps > step
        if not going.any():
            break
        passed, due = np.zeros(len(s), bool), going.copy()
        for attempt in range(max(x.max_retries for x in system.scenarios) + 1):
            again = np.zeros(len(s), bool)
            for scenario in system.scenarios:
                at = np.flatnonzero(due & (s["scenario"].to_numpy() == scenario.index))
                if not len(at):
                    continue
                client, edge = scenario.steps[step]
                gid = s["gid"].to_numpy()[at]
                requests = pd.DataFrame({"req_gid": gid * 256 + step * 16 + attempt, "gid": gid, "start_ms": clock[at], "tick": clock[at] // (plant.tick_s * 1000), "auth": s["auth"].to_numpy()[at]})
                outcome, end, hops = evaluator.trees(edge, requests, held, scenario.edge_mask)
                draw = lambda what, at=at, gid=gid: D.uniforms(plant.seed, CLIENTS, gid, np.full(len(at), step), np.full(len(at), attempt), np.full(len(at), what))
                failed = np.isin(outcome, (1, 2, 3))
                p = np.where(failed, M.CLIENT_ERR_ON_FAILURE, 0.0)
                p = np.where(s["net"].to_numpy()[at] == 1, 1 - (1 - p) * (1 - M.CLIENT_ERR_ON_FLAKY), p)
                err = (draw(0) < p) & ("err" in scenario.client_mask)
                clock[at] = end + CLIENT_PAUSE_MS
                passed[at] = ~err
                again[at] = err & np.isin(outcome, [OUTCOMES.index(x) for x in scenario.retry_on]) & (draw(3) < evaluator.again) & (attempt < scenario.max_retries)
                seen = pd.DataFrame({
                    "req_gid": requests["req_gid"], "gid": gid, "op": edge, "attempt": attempt, "parent_op": -1, "service": -1, "pod": 0, "outcome": np.where(err, 3, 0), "status": outcome, "start_ms": requests["start_ms"],
                    "end_ms": end + CLIENT_DELAY_MS, "duration_ms": end - requests["start_ms"], "own_ms": 0, "is_edge": False, "tick": requests["tick"], "state_health": 0, "state_pool": 0, "state_cache": 0, "state_load": 0,
                    "step": step, "client_op": client, "tagged": (draw(1) >= plant.constants["client.auto_captured_share"]) & failed, "sampled": draw(2) < plant.constants["client.txn_sampling"],
                })
                out += [hops, seen]
            due = again
            if not due.any():
                break
        gap = np.interp(D.uniforms(plant.seed, SESSION, s["gid"].to_numpy(), np.full(len(s), GAP), np.full(len(s), step)), M.KNOT_SHARES, plant.gap_knots)
        clock = np.where(going, clock + (gap * 1000).astype(np.int64), clock)
        going &= passed
    names = [c.split()[0] for c in f"{HOPS}, {CLIENT_COLUMNS}".split(", ")]
    if not out:
        return pd.DataFrame(columns=names)
    return pd.concat(out, ignore_index=True).assign(shard=int(s["shard"].iloc[0])).reindex(columns=names)


def traffic(plant: Plant, sessions: DataFrame, shard_states: DataFrame) -> DataFrame:
    """Hops and client rows of all sessions, shard by shard."""
    evaluator = Evaluator(plant)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return journeys(left, right, evaluator) if len(left) else pd.DataFrame(columns=[c.split()[0] for c in f"{HOPS}, {CLIENT_COLUMNS}".split(", ")])

    return sessions.groupBy("shard").cogroup(shard_states.groupBy("shard")).applyInPandas(run, f"{HOPS}, {CLIENT_COLUMNS}")


class Emitter:
    """The records of simulated traffic as the raw feed has them, and the oracle's tables beside them."""

    def __init__(self, plant: Plant):
        self.plant, self.c = plant, plant.constants
        s = plant.system
        text = lambda xs: F.array(*map(F.lit, xs))
        self.service_names, self.hosts, self.addresses = (text([getattr(x, k) for x in s.services]) for k in ("name", "host", "ip"))
        self.op_names = text([o.name for o in s.ops])
        self.op_service = F.array(*(F.lit(o.service) for o in s.ops))
        self.op_kind = F.array(*(F.lit(o.kind) for o in s.ops))
        pick = D.uniforms(plant.seed, EMIT, np.arange(len(s.ops)), np.zeros(len(s.ops)))
        self.methods = text([METHODS[int(u * len(METHODS))] for u in pick])
        self.pods = F.array(*(text(x.pods) if x.pods else F.array(F.lit("browser")) for x in s.services))

    def draw(self, domain: int, *parts) -> Column:
        return D.uniform(self.plant.seed, domain, *(p if isinstance(p, Column) else F.lit(p) for p in parts))

    def id(self, length: int, *parts) -> Column:
        return ids.hex_id(length, F.lit(self.plant.seed), *(p if isinstance(p, Column) else F.lit(p) for p in parts))

    def uuid(self, *parts) -> Column:
        return ids.uuid_id(F.lit(self.plant.seed), *(p if isinstance(p, Column) else F.lit(p) for p in parts))

    def iso(self, ms: Column) -> Column:
        return spans.iso_ms(ms + self.plant.epoch_ms)

    def skew(self, service: Column, pod: Column) -> Column:
        return D.normal(self.draw(SKEW, service, pod, 0), self.draw(SKEW, service, pod, 1)) * self.c["clock_skew_ms.server_sd"]

    def device(self, gid: Column) -> Column:
        return F.floor(self.draw(EMIT, gid, 1) * self.plant.config["counts"]["clients"]).cast("bigint")

    def named(self, traffic: DataFrame, sessions: DataFrame) -> DataFrame:
        """Traffic with the identities that its records share."""
        at, device = lambda array, i: F.get(array, i), F.col("device")
        rows = traffic.join(sessions.select("gid", "logged_in", self.device(F.col("gid")).alias("device")), "gid")
        rows = rows.withColumns({"edge_op": F.when(F.col("client_op").isNotNull(), F.col("op")), "parent_service": F.when(F.col("parent_op") >= 0, at(self.op_service, F.col("parent_op")))})
        return rows.withColumns(
            {
                "request_id": self.id(32, "req", F.col("req_gid"), F.col("op"), F.col("attempt")), "trace_id": self.id(32, "trace", F.col("req_gid")), "span_id": self.id(24, "access", F.col("req_gid"), F.col("op"), F.col("attempt")),
                "device_id": self.uuid("device", device), "account": F.when(F.col("logged_in"), self.id(64, "account", device)), "service_name": at(self.service_names, F.col("service")), "path": at(self.op_names, F.col("op")),
                "pod_name": F.get(at(self.pods, F.col("service")), F.col("pod")), "skew_ms": self.skew(F.col("service"), F.col("pod")),
            }
        )

    def edge_ids(self, hops: DataFrame) -> DataFrame:
        """(req_gid, edge_request_id, edge_span)."""
        return hops.filter("is_edge").select("req_gid", F.col("request_id").alias("edge_request_id"), F.col("span_id").alias("edge_span"))

    def access(self, hops: DataFrame) -> DataFrame:
        d = F.col("device")
        outer = F.concat(F.get(F.array(*map(F.lit, CLIENT_NETS)), (d % 3).cast("int")), F.lit("."), ((F.floor(d / 3) % 254) + 1).cast("string"))
        return hops.select(
            "shard", F.lit("vl.access").alias("kind"), self.iso(F.col("end_ms") + F.col("skew_ms")).alias("ts"), F.col("span_id").alias("log_id"), F.col("pod_name").alias("pod"), F.col("service_name").alias("service"),
            F.get(self.hosts, F.col("service")).alias("host"), F.get(self.methods, F.col("op")).alias("method"), "path", F.col("status").cast("bigint").alias("status"), F.round(F.col("duration_ms") / 1000.0, 3).alias("request_time"),
            F.when(F.col("is_edge"), F.round(F.col("own_ms") / 1000.0, 3).cast("string")).otherwise("-").alias("upstream_response_time"), "request_id", "trace_id",
            F.when(F.col("is_edge"), outer).otherwise(F.get(self.addresses, F.coalesce("parent_service", "service"))).alias("client_ip"), F.when(F.col("is_edge"), "tb-web/2.4 (browser)").otherwise("tb-http/1.1 (service)").alias("user_agent"),
            (200 + F.floor(self.draw(EMIT, F.col("req_gid"), F.col("op"), F.col("attempt"), 3) * 4000)).cast("int").alias("body_bytes"),
        )

    def lines(self, body: DataFrame, kind: str, source: str) -> DataFrame:
        """Application or audit lines, split into parts where they are long or by chance: the keys stand in one part, filler in the others.
        ``body``: shard, ts_ms, pod, service, level, message, tag and what keys its draws."""
        c = self.c
        keys = [F.col("req_gid"), F.col("op"), F.col("attempt"), F.col("tag")]
        pick = lambda what, share: D.categorical(self.draw(DEFECT, *keys, what), np.cumsum(share).tolist()) + 1
        split = (F.length("message") > c["split.cut_chars"]) | (self.draw(DEFECT, *keys) < c["split.rate"])
        parts = F.when(split, F.greatest(F.lit(2), pick(1, c["split.parts_pmf"]))).otherwise(1)
        rows = body.withColumn("total_parts", parts).withColumn("key_part", F.least(F.col("total_parts"), pick(2, c["split.key_part_pmf"])))
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("total_parts"))))
        filler = F.substring(F.repeat(F.lit(FILLER), 200), 1, int(c["split.cut_chars"]))
        return rows.select(
            "shard", F.lit(kind).alias("kind"), self.iso(F.col("ts_ms") + F.col("skew_ms")).alias("ts"), self.id(24, source, *keys).alias("log_id"), F.col("pod_name").alias("pod"), F.col("service_name").alias("service"), "part",
            "total_parts", "level", F.concat(F.lit(f"/srv/{source}.lua:"), F.col("tag").cast("string")).alias("log_source"), F.when((F.col("total_parts") == 1) | (F.col("part") == F.col("key_part")), F.col("message")).otherwise(filler).alias("message"),
        )

    def app(self, hops: DataFrame, edges: DataFrame) -> DataFrame:
        failed = F.col("outcome").isin(1, 2, 3)
        u = self.draw(EMIT, F.col("req_gid"), F.col("op"), F.col("attempt"), 4)
        n = F.when(failed, D.poisson(u, self.c["records_per_request.app_err"])).otherwise(D.poisson(u, self.c["records_per_request.app_ok"]))
        rows = hops.withColumn("n", n).filter("n > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).join(edges, "req_gid")
        keys = F.to_json(F.struct("request_id", "trace_id", F.when(~F.col("is_edge"), F.col("edge_request_id")).alias("correlation_id"), F.col("account").alias("sub")))
        moment = F.floor(self.draw(EMIT, F.col("req_gid"), F.col("op"), F.col("attempt"), 5, F.col("j")) * F.greatest(F.lit(1), F.col("duration_ms")))
        body = rows.withColumns({"ts_ms": F.col("start_ms") + moment, "level": F.when(failed & (F.col("j") == F.col("n") - 1), "ERROR").otherwise("INFO"), "tag": 10 + F.col("j"), "message": F.concat(F.lit("["), "service_name", F.lit("] request_context: "), keys, F.lit(f" {FILLER}"))})
        return self.lines(body, "vl.app", "app")

    def audit(self, hops: DataFrame, edges: DataFrame) -> DataFrame:
        """One line for each answer to a consumer and one, by the caller, for each call that leaves the system."""
        gid = F.col("gid")
        session, cart = self.uuid("session", gid), self.uuid("cart", gid)
        fallback = self.draw(DEFECT, F.col("req_gid"), F.col("op"), F.col("attempt"), 1) < self.c["cart_fallback_rate"]
        edge_keys = F.to_json(F.struct("request_id", F.col("request_id").alias("correlation_id"), "trace_id", F.when(fallback, cart).otherwise(session).alias("session_id"), cart.alias("cart_id"), F.col("device_id").alias("client_unique_header"), F.col("path").alias("url"), F.col("status").alias("response_status")))
        note = lambda keys: F.concat(F.lit("[audit] "), keys, F.lit(f" {FILLER}"))
        own = hops.filter("is_edge").withColumns({"ts_ms": F.col("end_ms") - 1, "level": F.lit("error"), "tag": F.lit(20), "message": note(edge_keys)})
        by = hops.filter("attempt = 0").select("req_gid", F.col("op").alias("parent_op"), F.col("request_id").alias("caller_request"), F.col("service_name").alias("caller_name"), F.col("pod_name").alias("caller_pod"))
        out = hops.filter((F.get(self.op_kind, F.col("op")) == EXTERNAL) & (F.col("parent_op") >= 0)).join(by, ["req_gid", "parent_op"]).join(edges, "req_gid")
        out_keys = F.to_json(F.struct(F.col("caller_request").alias("request_id"), F.col("edge_request_id").alias("correlation_id"), "trace_id", session.alias("session_id"), F.concat(F.lit("https://"), "service_name", F.lit(".example"), "path").alias("external_url"), F.col("status").alias("response_status")))
        out = out.withColumns({"ts_ms": F.col("end_ms"), "level": F.lit("error"), "tag": F.lit(21), "message": note(out_keys)}).withColumns({"service_name": F.col("caller_name"), "pod_name": F.col("caller_pod")})
        return self.lines(own, "vl.audit", "audit").unionByName(self.lines(out, "vl.audit", "audit"))

    def client(self, clients: DataFrame, edges: DataFrame) -> DataFrame:
        """Errors and sampled transactions of the front end; an error carries the requests of its session before it."""
        gid, step, k = F.col("gid"), F.col("step"), F.col("attempt")
        lag = D.normal(self.draw(SKEW, gid, 9, 0), self.draw(SKEW, gid, 9, 1)) * self.c["clock_skew_ms.browser_sd"]
        rows = clients.join(edges, "req_gid").withColumns({"at": F.col("end_ms") + lag, "page": F.concat(F.lit("https://app.example"), F.get(self.op_names, F.col("client_op"))), "strace": self.id(32, "strace", gid, step, k)})
        http = F.when(F.col("status").isin(0, 4), 200).when(F.col("status") == 1, 400).when(F.col("status") == 2, 500).otherwise(0)
        rows = rows.withColumn("http", http).withColumn("crumb", F.struct(self.iso(F.col("at")).alias("ts"), F.get(self.methods, F.col("edge_op")).alias("method"), F.col("http").alias("status"), F.concat(F.lit("https://app.example"), F.get(self.op_names, F.col("edge_op"))).alias("url")))
        rows = feed.breadcrumbs(rows, "gid", "end_ms", "crumb")
        common = ["shard", self.iso(F.col("at")).alias("ts"), F.col("strace").alias("sentry_trace_id"), F.col("page").alias("page_url")]
        tagged = lambda c: F.when(F.col("tagged"), c)
        errors = rows.filter("outcome = 3").select(
            *common, F.lit("sentry.error").alias("kind"), self.id(24, "sentry", gid, step, k).alias("log_id"), self.id(32, "sev", gid, step, k).alias("event_id"),
            F.when(F.col("http").isin(400, 500), F.concat(F.lit("AxiosError: Request failed with status code "), F.col("http").cast("string"))).otherwise("Error: Network Error").alias("title"),
            F.get(F.array(*map(F.lit, MODULES)), F.floor(self.draw(EMIT, gid, step, k, 6) * len(MODULES)).cast("int")).alias("error_module"), (F.floor(self.draw(EMIT, gid, step, k, 7) * 9) + 1).cast("string").alias("error_code"),
            F.when(F.col("status").isin(1, 2, 3), "BE").otherwise("FE").alias("http_failed"), F.col("crumbs").alias("breadcrumbs"), tagged(F.col("edge_request_id")).alias("request_id"), tagged(F.col("device_id")).alias("device_id"),
            tagged(F.coalesce("account", F.lit("empty"))).alias("account_id"),
        )
        txns = rows.filter("sampled").select(
            *common, F.lit("sentry.transaction").alias("kind"), self.id(24, "txn", gid, step, k).alias("log_id"), self.id(32, "txn-event", gid, step, k).alias("event_id"), "device_id", F.lit("http.client").alias("op"),
            F.concat_ws(" ", F.get(self.methods, F.col("edge_op")), F.get(self.op_names, F.col("edge_op"))).alias("description"), (F.col("duration_ms") + CLIENT_DELAY_MS).alias("duration_ms"), F.col("http").cast("bigint").alias("status"),
        )
        return errors.unionByName(txns, allowMissingColumns=True)

    def machinery(self, spark: SparkSession) -> DataFrame:
        """Health checks of every pod on a grid of its own, and background lines that carry no key."""
        plant, period = self.plant, int(self.c["health_check_period_s"] * 1000)
        pods = [(s.index, j, s.name, s.host, p) for s in plant.system.services for j, p in enumerate(s.pods)]
        end, shard_ms = plant.ticks * plant.tick_s * 1000, plant.config["run"]["shard_ticks"] * plant.tick_s * 1000
        rows = spark.createDataFrame(pods, "index int, j int, service string, host string, pod string")
        first = F.floor(self.draw(EMIT, F.col("index"), F.col("j"), 8) * period)
        checks = rows.withColumn("t", F.explode(F.sequence(first, F.lit(end - 1), F.lit(period))))
        skew = self.skew(F.col("index"), F.col("j"))
        check = checks.select(
            F.floor(F.col("t") / shard_ms).alias("shard"), F.lit("vl.access").alias("kind"), self.iso(F.col("t") + skew).alias("ts"), self.id(24, "healthz", F.col("index"), F.col("j"), F.col("t")).alias("log_id"), "pod", "service", "host", F.lit("GET").alias("method"),
            F.lit("/healthz").alias("path"), F.lit(200).cast("bigint").alias("status"), F.lit(0.001).alias("request_time"), F.lit("-").alias("upstream_response_time"), self.id(32, "hc", F.col("index"), F.col("j"), F.col("t")).alias("request_id"),
            F.lit("10.77.0.1").alias("client_ip"), F.lit("kube-probe/1.29").alias("user_agent"), F.lit(2).alias("body_bytes"),
        )
        n = int(round(self.c["background.app_lines_per_service_s"] * end / 1000))
        lines = rows.filter("j = 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(max(n, 1))))).filter(F.lit(n > 0)).withColumn("t", F.floor(self.draw(EMIT, F.col("index"), F.col("i"), 10) * end))
        line = lines.select(
            F.floor(F.col("t") / shard_ms).alias("shard"), F.lit("vl.app").alias("kind"), self.iso(F.col("t")).alias("ts"), self.id(24, "bg", F.col("index"), F.col("i")).alias("log_id"), F.lit(1).alias("part"), F.lit(1).alias("total_parts"), "pod", "service",
            F.lit("INFO").alias("level"), F.lit("/srv/daemons/Scheduler.lua").alias("log_source"), F.lit("[Scheduler] tick").alias("message"),
        )
        return check.unionByName(line, allowMissingColumns=True)

    def state_events(self, trajectory: DataFrame) -> DataFrame:
        """The change log that a variant which shows its states has in its feed."""
        w = Window.partitionBy("variable", "slot").orderBy("tick")
        changed = trajectory.withColumn("previous", F.coalesce(F.lag("value").over(w), F.lit(0))).filter("previous <> value")
        return changed.select(F.lit("sim.state").alias("kind"), self.iso(F.col("tick") * self.plant.tick_s * 1000).alias("ts"), self.id(24, "state", F.col("variable"), F.col("slot"), F.col("tick")).alias("log_id"), "variable", "slot", "value", "previous")

    def records(self, spark: SparkSession, rows: DataFrame) -> DataFrame:
        """The raw feed of ``named`` traffic; ``sources.corpus.write_feed`` writes it."""
        hops, clients = rows.filter("client_op is null"), rows.filter("client_op is not null")
        edges = self.edge_ids(hops)
        out = self.access(hops)
        for part in (self.app(hops, edges), self.audit(hops, edges), self.client(clients, edges), self.machinery(spark)):
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def oracle_spans(self, rows: DataFrame) -> DataFrame:
        """The true spans: span_id, parent, op, outcome, times, session, and the states that were in force. The parent of a hop is the first
        attempt of its caller."""
        hops = rows.filter("client_op is null")
        first = hops.filter("attempt = 0").select("req_gid", F.col("op").alias("parent_op"), F.col("span_id").alias("parent"))
        return hops.join(first, ["req_gid", "parent_op"], "left").select(
            "span_id", "parent", "op", F.col("service_name").alias("service"), F.col("path").alias("name"), "outcome", "status", "attempt", "start_ms", "duration_ms", "own_ms", "req_gid", F.col("gid").alias("session_gid"), "is_edge", "tick",
            "state_health", "state_pool", "state_cache", "state_load",
        )

    def oracle_linkage(self, rows: DataFrame, records: DataFrame) -> DataFrame:
        """For each record its true request, session, device and operation: log_id, part, kind, op, req_gid, session_gid, device_index,
        edge_request_id, parent_log_id. Records of no request (health checks, background lines) have none."""
        hops = rows.filter("client_op is null")
        keys = [F.col("req_gid"), F.col("op"), F.col("attempt")]
        common = ["req_gid", F.col("gid").alias("session_gid"), F.col("device").alias("device_index")]
        own = hops.select(F.col("span_id").alias("log_id"), "op", *common, F.lit(None).cast("string").alias("parent_log_id"))
        first = hops.filter("attempt = 0").select("req_gid", F.col("op").alias("parent_op"), F.col("span_id").alias("up"))
        own = own.join(hops.join(first, ["req_gid", "parent_op"], "left").select(F.col("span_id").alias("log_id"), "up"), "log_id").withColumn("parent_log_id", F.col("up")).drop("up")
        tags = hops.withColumn("tag", F.explode(F.sequence(F.lit(10), F.lit(21)))).withColumn("source", F.when(F.col("tag") < 20, "app").otherwise("audit"))
        lines = tags.select(ids.hex_id(24, F.lit(self.plant.seed), F.col("source"), *keys, F.col("tag")).alias("log_id"), "op", *common, F.col("span_id").alias("parent_log_id"))
        clients = rows.filter("client_op is not null")
        of = lambda name: clients.select(self.id(24, name, F.col("gid"), F.col("step"), F.col("attempt")).alias("log_id"), F.col("client_op").alias("op"), *common, self.id(24, "access", F.col("req_gid"), F.col("edge_op"), 0).alias("parent_log_id"))
        every = own.unionByName(lines).unionByName(of("sentry")).unionByName(of("txn"))
        named = records.select("log_id", F.coalesce("part", F.lit(1)).alias("part"), "kind").join(every, "log_id", "left")
        return named.join(self.edge_ids(hops).select("req_gid", "edge_request_id"), "req_gid", "left")

    def with_states(self, access: DataFrame, rows: DataFrame) -> DataFrame:
        """Access records with the names of the states that were in force: what a variant that shows them has."""
        named = [F.get(F.array(*map(F.lit, M.VALUES[g])), F.col(f"state_{g}")).alias(f"state_{g}") for g in ("health", "pool", "cache", "load")]
        return access.join(rows.filter("client_op is null").select(F.col("span_id").alias("log_id"), *named, F.col("attempt").alias("state_retry")), "log_id", "left")

    def oracle_sessions(self, sessions: DataFrame, rows: DataFrame) -> DataFrame:
        """Sessions with their identities, the steps they got to and whether all went well."""
        last = F.max_by(F.col("outcome") == 0, F.struct("step", "attempt"))
        done = rows.filter("client_op is not null").groupBy("gid").agg((F.max("step") + 1).alias("steps_done"), last.alias("last_ok"))
        sizes = F.array(*(F.lit(len(s.steps)) for s in self.plant.system.scenarios))
        gid = F.col("gid")
        out = sessions.join(done, "gid", "left").withColumns({"device_index": self.device(gid), "session_id": self.uuid("session", gid), "cart_id": self.uuid("cart", gid)}).withColumn("device_id", self.uuid("device", F.col("device_index")))
        return out.withColumn("final_ok", F.coalesce(F.col("last_ok") & (F.col("steps_done") == F.get(sizes, F.col("scenario"))), F.lit(False))).drop("last_ok")


def corpus(spark: SparkSession, plant: Plant) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, true spans, true sessions) of a whole simulation."""
    from hopwright.storage import Rounds

    settle = lambda df, name: Rounds(spark, name).settle(df)
    sessions = settle(arrivals(spark, plant), "sessions")
    rows = settle(traffic(plant, sessions, states_by_shard(plant, settle(states(spark, plant), "states"))), "traffic")
    emitter = Emitter(plant)
    named = settle(emitter.named(rows, sessions), "named")
    return emitter.records(spark, named), emitter.oracle_spans(named), emitter.oracle_sessions(sessions, named)


def estimate(plant: Plant) -> dict[str, float]:
    """Expected sessions, requests, records and compressed gigabytes, before anything is made: what a cap is held against."""
    hours, days = plant.constants["daily_profile"], plant.constants["weekday"]
    start = plant.epoch_ms // 1000 + np.arange(0, plant.ticks, max(1, 60 // plant.tick_s)) * plant.tick_s
    profile = np.array(hours)[start // 3600 % 24] * np.array(days)[(start // 86400 + 3) % 7]
    sessions = plant.config["run"]["base_rps"] * profile.mean() * plant.ticks * plant.tick_s
    requests = sessions * sum(s.weight * len(s.steps) for s in plant.system.scenarios)
    per = sum(plant.constants[f"records_per_request.{k}"] for k in ("access", "app_ok", "audit"))
    records = requests * max(per, 1.0) * max(1.0, np.mean([len(plant.system.reach(o.id)) for o in plant.system.of_kind(EDGE)]) / 2)
    return {"sessions": float(sessions), "requests": float(requests), "records": float(records), "gb": float(records * plant.constants["bytes_per_record.vl"] * plant.constants["gzip_ratio"] / 1e9)}


def forced(plant: Plant, edge: int, child: str, force: dict[str, str], n: int = 20_000) -> np.ndarray:
    """Shares of a variable's values among requests to ``edge`` with others held: what the mechanism's distributions are checked against,
    by simulation. ``child`` is an invocation, attempt or final of a backend operation, or 'T' for the edge's own attempt; states (load,
    pool, cache, health) are nominal where they are not held."""
    mask = next(s.edge_mask for s in plant.system.scenarios if any(e == edge for _, e in s.steps))
    requests = pd.DataFrame({"req_gid": np.arange(n), "gid": np.arange(n), "start_ms": np.zeros(n, np.int64), "tick": np.zeros(n, np.int64), "auth": np.full(n, int(force.get("auth") == "expired"))})
    names = {"load": latents.LOAD, "pool": latents.POOL, "cache": latents.CACHE, "health": latents.HEALTH}
    states = [(0, names[g], int(k), M.VALUES[g].index(x)) for node, x in force.items() for g, _, k in [node.partition(":")] if g in names]
    held = _States(pd.DataFrame(states, columns=["tick", "variable", "slot", "value"]))
    outcome, _, hops = Evaluator(plant, force).trees(edge, requests, held, mask)
    kind, *rest = child.split(":")
    if kind == "T":
        return np.bincount(outcome, minlength=6) / n
    rows = hops[hops["op"] == int(rest[0])].sort_values("attempt")
    if kind == "I":
        called = rows["req_gid"].nunique() / n
        return np.array([called, 1 - called])
    found = rows[rows["attempt"] == int(rest[1])] if kind == "A" else rows.drop_duplicates("req_gid", keep="last")
    shares = np.bincount(found["outcome"], minlength=6) / n
    shares[ABSENT] = 1 - shares[:ABSENT].sum()
    return shares


def forced_effect(plant: Plant, edge: int, values: list[int], variable: int, slot: int, n: int = 20_000) -> list[np.ndarray]:
    """Outcome shares of an edge operation with one hidden state held at each of ``values``."""
    group = {latents.LOAD: "load", latents.POOL: "pool", latents.CACHE: "cache", latents.HEALTH: "health"}[variable]
    return [forced(plant, edge, "T", {f"{group}:{slot}": M.VALUES[group][x]}, n) for x in values]
