"""The causal mechanism of a system as a network of variables with conditional distributions.

Hidden states (intensity, load, pool, cache, health, net, auth) move what requests come to: an operation is invoked by its callers, an
attempt's class depends on its own state and on the worst critical callee, retries follow failures, clients see what the edge answers.
The network is as large as the configuration and lives on the driver; ``strengths`` and the projection fan its pairs out.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from hopwright.config import Constants
from hopwright.functions.draws import uniforms
from hopwright.functions.ids import stable_hex
from hopwright.topology import EDGE, EXTERNAL, SERVICE, TIERS, System

#: The values of each variable, the nominal one first.
VALUES = {
    "intensity": ("day", "night", "peak"), "load": ("mid", "low", "high"), "pool": ("free", "tight", "exhausted"), "cache": ("warm", "cold"), "health": ("healthy", "degraded", "failed"),
    "net": ("good", "flaky"), "auth": ("valid", "expired"), "invoke": ("present", "absent"), "attempt": ("ok", "4xx", "5xx", "err", "slow", "absent"), "client": ("ok", "err", "absent"),
}
GROUPS = ("intensity", "load", "pool", "cache", "health", "net", "auth")
CLASSES = ("ok", "4xx", "5xx", "err")
SEVERITY = {"4xx": 1, "5xx": 2, "err": 3}
#: The class of a caller that a callee's failure reaches (ok, 4xx, 5xx, err).
PROPAGATION = {"4xx": (0.10, 0.80, 0.10, 0.0), "5xx": (0.05, 0.0, 0.85, 0.10), "err": (0.05, 0.0, 0.35, 0.60)}
CLIENT_ERR_ON_FAILURE, CLIENT_ERR_ON_FLAKY, EDGE_4XX_ON_EXPIRED = 0.98, 0.05, 0.90
#: The distribution of load (mid, low, high) by intensity.
LOAD_TARGET = {"day": (0.70, 0.15, 0.15), "night": (0.25, 0.70, 0.05), "peak": (0.30, 0.0, 0.70)}
CACHE_MID = 0
#: Probabilities of the knots of a latency quantile function, the pause before a backend retry.
KNOT_SHARES = (0.0, 0.5, 0.9, 0.95, 0.99, 1.0)
RETRY_PAUSE_S = 0.05
LATENCY_DOMAIN = 11


def stationary(rows: np.ndarray, tolerance: float = 1e-13, rounds: int = 100_000) -> np.ndarray:
    """The distribution that a stochastic matrix leaves as it is, by powers."""
    p = np.full(len(rows), 1 / len(rows))
    for _ in range(rounds):
        after = p @ rows
        done = np.abs(after - p).max() < tolerance
        p = after
        if done:
            break
    p = np.maximum(p, 0)
    return p / p.sum()


def load_rows(constants: Constants) -> np.ndarray:
    """[intensity][load] to the next load."""
    stay = constants["state_dynamics.load_persist"]
    return np.array([(1 - stay) * np.array(LOAD_TARGET[i]) + stay * np.eye(3) for i in VALUES["intensity"]])


def pool_rows(constants: Constants) -> np.ndarray:
    """[load][pool] to the next pool."""
    tight, gone, back = (constants[f"state_dynamics.{k}"] for k in ("pool_tight_given_high", "pool_exhausted_given_high", "pool_recover"))
    out = np.zeros((3, 3, 3))
    for i, load in enumerate(VALUES["load"]):
        t, g = (tight, gone) if load == "high" else (tight / 10, 0.0)
        b, r = back * (2 if load == "low" else 1), back * (0.3 if load == "high" else 1)
        out[i] = [[1 - t, t, 0], [b, 1 - b - g, g], [0, r, 1 - r]]
    return out


def cache_rows(constants: Constants) -> np.ndarray:
    """[load][cache] to the next cache."""
    cool, stay = constants["state_dynamics.cache_cold_given_high"], constants["state_dynamics.cache_persist_cold"]
    return np.array([[[1 - c, c], [1 - stay, stay]] for c in (cool if load == "high" else cool / 10 for load in VALUES["load"])])


def health_rows(constants: Constants) -> np.ndarray:
    """[pool][health] to the next health."""
    worn, base, fail, heal = (constants[f"state_dynamics.{k}"] for k in ("health_degraded_given_exhausted", "health_degraded_base", "health_failed_given_degraded", "health_recover"))
    out = np.zeros((3, 3, 3))
    for i, pool in enumerate(VALUES["pool"]):
        d, r = (worn, 0.0) if pool == "exhausted" else (base, heal)
        out[i] = [[1 - d, d, 0], [r, 1 - r - fail, fail], [0, heal, 1 - heal]]
    return out


def class_rows(constants: Constants, multiplier: float) -> dict[str, np.ndarray]:
    """Per tier [health][pool] to the class of an attempt whose callees are well. A failed endpoint has its own distribution; a degraded
    one, or an exhausted pool, fails a fixed share of requests besides the nominal ones."""
    as_row = lambda m: np.array([m[c] for c in CLASSES])
    shifts = {k: as_row(constants[f"error_shift.{k}"]) for k in ("degraded", "failed", "pool_exhausted")}
    out = {}
    for tier in TIERS.values():
        bad = np.array([constants.error_rates(tier)[c] * multiplier for c in CLASSES[1:]])
        bad *= min(1.0, 0.95 / max(bad.sum(), 1e-12))
        nominal, rows = np.concatenate(([1 - bad.sum()], bad)), np.zeros((3, 3, 4))
        for h, p in itertools.product(range(3), range(3)):
            row = nominal.copy()
            for name in [k for k, on in (("degraded", h == 1), ("pool_exhausted", p == 2)) if on]:
                failing = shifts[name].copy()
                failing[0] = 0.0
                row = shifts[name][0] * row + failing
                row /= row.sum()
            rows[h, p] = shifts["failed"] if h == 2 else row
        out[tier] = rows
    return out


@dataclass
class Variable:
    id: str
    group: str
    values: tuple[str, ...]
    parents: list[str]
    chances: Callable[[dict[str, str]], np.ndarray]
    op: int | None = None
    latent: bool = False
    derived: bool = False
    lagged: bool = False
    #: Values that other parents are held at where they are not nominal, and what a parent's being looked at holds others at.
    held: dict[str, str] = field(default_factory=dict)
    given: dict[str, dict[str, str]] = field(default_factory=dict)


class Network:
    def __init__(self):
        self.nodes: dict[str, Variable] = {}
        self._settled: dict = {}

    def add(self, v: Variable) -> Variable:
        if v.id in self.nodes:
            raise ValueError(f"{v.id} is there twice")
        self.nodes[v.id] = v
        return v

    def context(self, node: str, assigned: dict[str, str]) -> dict[str, str]:
        """The values of a node's parents: as assigned, else as held, else nominal."""
        v = self.nodes[node]
        out = {p: v.held.get(p, self.nodes[p].values[0]) for p in v.parents if p != node}
        for p in assigned:
            if p in v.parents:
                out |= v.given.get(p, {})
        return out | {p: x for p, x in assigned.items() if p in v.parents}

    def distribution(self, node: str, context: dict[str, str]) -> np.ndarray:
        """With all parents held for long: a variable that depends on its own last value is at rest then."""
        v = self.nodes[node]
        key = (node, *(context.get(p) for p in v.parents))
        if key not in self._settled:
            if v.lagged:
                p = stationary(np.array([v.chances({**context, node: x}) for x in v.values]))
            else:
                p = np.asarray(v.chances(context), float)
            self._settled[key] = p
        return self._settled[key]

    def possible(self, parent: str, value: str, context: dict[str, str]) -> bool:
        """Whether a parent can have a value while other variables of its operation are held as in ``context``: attempts and finals are
        absent with their invocation, and a later attempt with an earlier one."""
        rank = self._rank(parent)
        if rank is None:
            return True
        for other, held in context.items():
            r = self._rank(other)
            if other == parent or r is None or r[0] != rank[0]:
                continue
            before, after = (held, value) if r[1] < rank[1] else (value, held)
            if r[1] != rank[1] and before == "absent" and after != "absent":
                return False
        return True

    def _rank(self, node: str) -> tuple[str, float] | None:
        """The operation and the place of invocations, attempts and finals in time; a final is there as soon as its first attempt is."""
        kind, *rest = node.split(":")
        if kind not in ("I", "A", "F") or not rest or rest[0] == "bff":
            return None
        return rest[0], -1.0 if kind == "I" else float(rest[1]) if kind == "A" else 0.5

    def strength(self, parent: str, child: str, context: dict[str, str] | None = None) -> float:
        """The greatest total variation between the child's distributions under two values of the parent."""
        base = self.context(child, {}) | self.nodes[child].given.get(parent, {}) if context is None else context
        base = {p: x for p, x in base.items() if p != parent}
        rows = [self.distribution(child, base | {parent: x}) for x in self.nodes[parent].values if self.possible(parent, x, base)]
        return max((float(np.abs(a - b).sum() / 2) for a, b in itertools.combinations(rows, 2)), default=0.0)

    def strength_anywhere(self, parent: str, child: str, most: int = 4) -> float | None:
        """The greatest strength over all values of the other parents, where these are few."""
        others = [p for p in self.nodes[child].parents if p not in (parent, child)]
        if len(others) > most:
            return None
        return max(self.strength(parent, child, dict(zip(others, x))) for x in itertools.product(*(self.nodes[p].values for p in others)))

    def edges(self) -> list[tuple[str, str, float]]:
        return [(p, c, round(self.strength(p, c), 6)) for c, v in self.nodes.items() for p in v.parents if p != c]

    def loops(self) -> list[str]:
        return [c for c, v in self.nodes.items() if v.lagged]


def worst_reached(calls: list, classes: dict[int, str]) -> np.ndarray:
    """Chances of the worst class that reaches a caller: of critical callees each failure gets through with its own chance, the more
    severe first."""
    out, rest = np.zeros(4), 1.0
    for cls in reversed(CLASSES[1:]):
        none = np.prod([1 - c.rho for c in calls if c.critical and classes.get(c.callee, "ok") == cls])
        out[SEVERITY[cls]], rest = rest * (1 - none), rest * none
    out[0] = rest
    return out


class Latency:
    """Durations: own time by a quantile function, callees' time on top; an operation is slow beyond a quantile of its nominal total.

    Totals are sampled bottom-up with keyed draws, so no order of calls changes them.
    """

    def __init__(self, system: System, config: dict, constants: Constants, seed: int, samples: int | None = None):
        self.system, self.seed, self.n = system, seed, samples or config["mechanism"]["mc_samples"]
        self.knots = {o.id: (0.0, *(q := constants.quantiles(TIERS[o.kind])), 3 * q[3]) for o in system.of_kind(EDGE, SERVICE, EXTERNAL)}
        m = {k: constants[f"latency_multipliers.{k}"] for k in ("degraded", "pool_tight", "pool_exhausted", "cache_cold")}
        self.by_health, self.by_pool, self.by_cache = (1.0, m["degraded"], 1.0), (1.0, m["pool_tight"], m["pool_exhausted"]), (1.0, m["cache_cold"])
        retry, mask = config["endpoints"]["retry"], config["endpoints"]["repertoire"]
        rows = class_rows(constants, config["mechanism"]["error_rate_multiplier"])
        self.retry = {o.id: self._retry_chance(rows[TIERS[o.kind]][0, 0], retry, mask, constants["retry.p_retry_5xx"]) for o in system.of_kind(SERVICE, EXTERNAL)}
        self.totals: dict[int, np.ndarray] = {}
        self.threshold: dict[int, float] = {}
        self._slow: dict = {}
        for o in sorted(system.of_kind(EDGE, SERVICE, EXTERNAL), key=lambda o: -o.depth):
            self.totals[o.id] = self.sampled(o.id, {}, key=("nominal", o.id))
            self.threshold[o.id] = round(float(np.quantile(self.totals[o.id], config["slow"]["quantile"])), 9)

    @staticmethod
    def _retry_chance(row: np.ndarray, retry: dict, mask: list[str], p: float) -> float:
        """How often a nominal attempt is followed by another."""
        row = row * [c == "ok" or c in mask for c in CLASSES]
        return float(sum(row[CLASSES.index(c)] for c in retry["retry_on"] if c in CLASSES) / row.sum() * p) if retry["max_retries"] else 0.0

    def own(self, op: int, u: np.ndarray) -> np.ndarray:
        return np.interp(u, KNOT_SHARES, self.knots[op])

    def multiplier(self, health, pool, cold):
        return np.take(self.by_health, health) * np.take(self.by_pool, pool) * np.take(self.by_cache, cold)

    def sampled(self, op: int, classes: dict[int, str], health: int = 0, pool: int = 0, cold: bool = False, retry: dict[int, float] | None = None, key=()) -> np.ndarray:
        """Totals under an own state and final classes of callees. A callee of a given class was called, and took as long as that class
        allows; any other is called, answered by the cache and retried as nominal."""
        name, i = int(stable_hex(*key, length=12), 16), np.arange(self.n)
        draw = lambda what, j=0: uniforms(self.seed, LATENCY_DOMAIN, np.full(self.n, name), i, np.full(self.n, j * 8 + what))
        total = self.own(op, draw(0)) * float(self.multiplier(health, pool, int(cold)))
        for c in self.system.calls_of[op]:
            given = classes.get(c.callee)
            if given == "absent":
                continue
            base = self.totals[c.callee]
            part = base[(draw(1, c.index + 1) * len(base)).astype(int)]
            if given is not None:
                limit = self.threshold[c.callee]
                part = np.maximum(part, limit * 1.0001) if given == "slow" else np.minimum(part, limit)
            again = (retry or {}).get(c.callee, 0.0 if given is not None else self.retry.get(c.callee, 0.0))
            if again:
                part = part + np.where(draw(2, c.index + 1) < again, self.own(c.callee, draw(3, c.index + 1)) + RETRY_PAUSE_S, 0.0)
            if given is None:
                part = np.where((draw(4, c.index + 1) < c.p_call) & ~(c.cached & (draw(5, c.index + 1) < c.p_hit)), part, 0.0)
            total = total + part
        return total

    def slow_chance(self, op: int, health: int, pool: int, cold: bool, classes: dict[int, str], retry: dict[int, float]) -> float:
        key = (op, health, pool, cold, tuple(sorted(classes.items())), tuple(sorted(retry.items())))
        if key not in self._slow:
            self._slow[key] = float(np.mean(self.sampled(op, classes, health, pool, cold, retry, key=("slow", *key)) > self.threshold[op]))
        return self._slow[key]


def attempt_row(system: System, rows: dict, latency: Latency, op: int, present: float, health: int, pool: int, cold: bool, classes: dict[int, str], retry: dict[int, float], mask, expired: bool = False) -> np.ndarray:
    """The distribution of an attempt: its class by own state, or by the worst failure that reaches it, within the repertoire; slow ones
    are taken from the ok; all of it where the attempt is made at all."""
    out = np.zeros(6)
    out[5] = 1 - present
    if present <= 0:
        return out
    worst = worst_reached(system.calls_of[op], classes)
    p = worst[0] * rows[TIERS[system.ops[op].kind]][health, pool] + sum(worst[SEVERITY[c]] * np.array(PROPAGATION[c]) for c in CLASSES[1:])
    allowed = np.array([c == "ok" or c in mask for c in CLASSES])
    p = p * allowed / (p * allowed).sum()
    if expired:
        p = (1 - EDGE_4XX_ON_EXPIRED) * p + EDGE_4XX_ON_EXPIRED * np.eye(4)[1]
        p = p * allowed / (p * allowed).sum()
    slow = latency.slow_chance(op, health, pool, cold, classes, retry) if "slow" in mask else 0.0
    out[:5] = present * np.array([p[0] * (1 - slow), *p[1:], p[0] * slow])
    return out


def last_made(values: tuple[str, ...], attempts: list[str]) -> Callable[[dict], np.ndarray]:
    """The outcome of the last attempt that was made."""

    def chances(context: dict[str, str]) -> np.ndarray:
        made = [context[a] for a in attempts if context[a] != "absent"]
        return np.eye(len(values))[values.index(made[-1] if made else "absent")]

    return chances


def build(system: System, config: dict, constants: Constants, latency: Latency) -> Network:
    """The network of a system, in an order in which journeys come last."""
    net = Network()
    rows = class_rows(constants, config["mechanism"]["error_rate_multiplier"])
    loads, pools, caches, healths = load_rows(constants), pool_rows(constants), cache_rows(constants), health_rows(constants)
    again, retry, mask = constants["retry.p_retry_5xx"], config["endpoints"]["retry"], config["endpoints"]["repertoire"]
    at = lambda group, context, node: VALUES[group].index(context[node])

    def chain(node: str, group: str, by: str, by_group: str, table: np.ndarray, op=None) -> None:
        net.add(Variable(node, group, VALUES[group], [by, node], lambda c: table[at(by_group, c, by), at(group, c, node)], op=op, latent=True, lagged=True))

    net.add(Variable("intensity", "intensity", VALUES["intensity"], [], lambda c: np.array([1.0, 0, 0]), latent=True))
    for s in system.services:
        if s.kind != 2:
            chain(f"load:{s.index}", "load", "intensity", "intensity", loads)
            chain(f"pool:{s.index}", "pool", f"load:{s.index}", "load", pools)
            chain(f"cache:{s.index}", "cache", f"load:{s.index}", "load", caches)
    for o in system.of_kind(EDGE, SERVICE, EXTERNAL):
        chain(f"health:{o.id}", "health", f"pool:{o.service}", "pool", healths)
    for s in system.scenarios:
        for group, share in (("net", constants["client.net_flaky_share"]), ("auth", constants["client.auth_expired_share"])):
            net.add(Variable(f"{group}:{s.index}", group, VALUES[group], [], lambda c, share=share: np.array([1 - share, share]), latent=True))
    visits: dict[int, list[str]] = {}
    for s in system.scenarios:
        for j, (_, edge) in enumerate(s.steps):
            visits.setdefault(edge, []).extend(f"I:bff:{s.index}:{j}:{k}" for k in range(s.max_retries + 1))

    def attempt(node: str, op: int, before: str, present: Callable[[str], float], masked, auth: str | None = None, held=None) -> None:
        own, inner = system.ops[op], [c.callee for c in system.calls_of[op]]
        cached = any(c.cached for c in system.calls_of[op])
        health, pool, cache = f"health:{op}", f"pool:{own.service}", f"cache:{own.service}"
        firsts = [f"A:{v}:0" for v in inner] if retry["max_retries"] else []
        parents = [before, *([auth] if auth else []), health, pool, *([cache] if cached else []), *(f"F:{v}" for v in inner), *firsts]

        def chances(c: dict[str, str]) -> np.ndarray:
            more = {v: again if c[f"A:{v}:0"] in retry["retry_on"] else 0.0 for v in inner} if firsts else {}
            return attempt_row(system, rows, latency, op, present(c[before]), at("health", c, health), at("pool", c, pool), cached and c[cache] == "cold", {v: c[f"F:{v}"] for v in inner}, more, masked, bool(auth) and c[auth] == "expired")

        net.add(Variable(node, "attempt", VALUES["attempt"], list(dict.fromkeys(parents)), chances, op=op, held=held or {}))

    def final(node: str, group: str, attempts: list[str], op: int) -> None:
        # With later attempts held absent the first one's effect is the controlled one without retries.
        net.add(Variable(node, "final", VALUES[group], attempts, last_made(VALUES[group], attempts), op=op, derived=True, held={a: "absent" for a in attempts[1:]}))

    for o in sorted(system.of_kind(SERVICE, EXTERNAL), key=lambda o: -o.depth):
        calls = [(p, c) for c in system.callers_of[o.id] for p in (visits.get(c.caller, []) if system.ops[c.caller].kind == EDGE else [f"I:{c.caller}"])]
        cache = lambda c: f"cache:{system.ops[c.caller].service}"
        parents = list(dict.fromkeys(x for p, c in calls for x in ((p, cache(c)) if c.cached else (p,))))

        def invoked(context: dict[str, str], calls=calls) -> np.ndarray:
            none = 1.0
            for p, c in calls:
                if context[p] == "present":
                    none *= 1 - c.p_call * (1 - c.p_hit if c.cached and context[cache(c)] == "warm" else 1.0)
            return np.array([1 - none, none])

        given: dict[str, dict[str, str]] = {}
        for p, c in calls:
            if c.cached:
                given.setdefault(cache(c), {p: "present"})
        net.add(Variable(f"I:{o.id}", "invoke", VALUES["invoke"], parents, invoked, op=o.id, derived=True, held={p: "absent" for p, _ in calls}, given=given))
        names = [f"A:{o.id}:{k}" for k in range(retry["max_retries"] + 1)]
        for k, node in enumerate(names):
            before = names[k - 1] if k else f"I:{o.id}"
            attempt(node, o.id, before, (lambda x: again if x in retry["retry_on"] else 0.0) if k else (lambda x: float(x == "present")), mask, held={before: "absent"} if k >= 2 else None)
        final(f"F:{o.id}", "attempt", names, o.id)
    for s in system.scenarios:
        for j, (client, edge) in enumerate(s.steps):
            seen = [f"C:{s.index}:{j}:{k}" for k in range(s.max_retries + 1)]
            for k, c in enumerate(seen):
                i, t = f"I:bff:{s.index}:{j}:{k}", f"T:bff:{s.index}:{j}:{k}"
                before = f"T:bff:{s.index}:{j}:{k - 1}" if k else f"C:{s.index}:{j - 1}:F" if j else None

                def asked(context: dict[str, str], before=before, k=k, s=s) -> np.ndarray:
                    p = 1.0 if before is None else (again if context[before] in s.retry_on else 0.0) if k else float(context[before] == "ok")
                    return np.array([p, 1 - p])

                net.add(Variable(i, "invoke", VALUES["invoke"], [before] if before else [], asked, op=edge, derived=True, held={before: "absent"} if k >= 2 else {}))
                attempt(t, edge, i, lambda x: float(x == "present"), s.edge_mask, f"auth:{s.index}")

                def shown(context: dict[str, str], t=t, s=s) -> np.ndarray:
                    if context[t] == "absent":
                        return np.array([0.0, 0, 1])
                    p = CLIENT_ERR_ON_FAILURE if context[t] in SEVERITY else 0.0
                    p = 1 - (1 - p) * (1 - CLIENT_ERR_ON_FLAKY) if context[f"net:{s.index}"] == "flaky" else p
                    p = p if "err" in s.client_mask else 0.0
                    return np.array([1 - p, p, 0])

                net.add(Variable(c, "client", VALUES["client"], [t, f"net:{s.index}"], shown, op=client))
            final(f"C:{s.index}:{j}:F", "client", seen, client)
    return net
