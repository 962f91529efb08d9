"""Instance configurations and fitted constants: read, checked as a whole, refused with every problem found.

A configuration is a nested mapping. ``FIELDS`` names each leaf by its path ('[]' stands for the entries of a list) with a rule; what
is not named there is refused. Rules about several fields follow in ``cross_problems``.
"""

from __future__ import annotations

import copy
import json
import math
import os
import re
from collections.abc import Callable
from datetime import datetime, timezone

OUTCOMES = ("ok", "4xx", "5xx", "err", "slow")
RETRIED = ("4xx", "5xx", "err", "slow")
FAULTS = ("crash", "degrade", "pool_exhaust", "cache_flush", "breaker_open")
LEAST_SEEDS = 5
NAME = r"[a-z][a-z0-9-]{1,31}"

Rule = tuple[Callable[[object], bool], str]


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)


def whole(least: int) -> Rule:
    return lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= least, f"must be a whole number of at least {least}"


def above(least: float, most: float = math.inf) -> Rule:
    return lambda v: _number(v) and least < v < most, f"must be a number above {least:g}" + (f" and below {most:g}" if most < math.inf else "")


def share() -> Rule:
    return lambda v: _number(v) and 0 <= v <= 1, "must be a probability in [0, 1]"


def at_least(least: float) -> Rule:
    return lambda v: _number(v) and v >= least, f"must be a finite number of at least {least:g}"


def text(pattern: str) -> Rule:
    return lambda v: isinstance(v, str) and re.fullmatch(pattern, v) is not None, f"must match {pattern}"


def flag() -> Rule:
    return lambda v: isinstance(v, bool), "must be true or false"


def some_of(names: tuple[str, ...], least: int = 1) -> Rule:
    return lambda v: isinstance(v, list) and len(v) >= least and all(x in names for x in v), f"must be a list of {', '.join(names)}"


def pmf() -> Rule:
    return lambda v: isinstance(v, list) and bool(v) and all(_number(p) and p >= 0 for p in v) and abs(sum(v) - 1) < 1e-6, "must be a non-empty list of non-negative numbers that sum to 1"


def numbers(rule: Rule, size: int | None = None) -> Rule:
    return lambda v: isinstance(v, list) and (size is None or len(v) == size) and all(map(rule[0], v)), f"must be {size if size else 'a list of'} values, each of which {rule[1]}"


def pmf_by(keys: tuple[str, ...]) -> Rule:
    return lambda v: isinstance(v, dict) and set(v) == set(keys) and pmf()[0](list(v.values())), f"must map {', '.join(keys)} to probabilities that sum to 1"


def anything() -> Rule:
    return lambda v: True, ""


FIELDS: dict[str, Rule] = {
    "name": text(r"[a-z][a-z0-9-]{0,31}"), "rung": text("local|cloud"), "constants": text(".+"), "schema_version": text(".+"),
    **{f"counts.{c}": whole(1) for c in ("clients", "services", "endpoints_per_service", "bff_endpoints", "scenarios")},
    "scenarios[].name": text(NAME), "scenarios[].steps": whole(1), "scenarios[].weight": above(0), "scenarios[].repertoire.client": some_of(("ok", "err")), "scenarios[].repertoire.bff": some_of(OUTCOMES),
    "scenarios[].retry.max_retries": whole(0), "scenarios[].retry.retry_on": some_of(RETRIED, 0), "scenarios[].fatal_error": flag(), "scenarios[].terminal_failure": flag(),
    "endpoints.repertoire": some_of(OUTCOMES), "endpoints.retry.max_retries": whole(0), "endpoints.retry.retry_on": some_of(RETRIED, 0),
    "topology.depth_pmf": pmf(), "topology.fanout_mean": above(0), "topology.external_services": whole(0), "topology.criticality_share": share(), "topology.cache_hit_share": share(),
    "mechanism.floor": share(), "mechanism.sweep": numbers(share()), "mechanism.error_rate_multiplier": above(0), "mechanism.ctxmax": flag(), "mechanism.mc_samples": whole(1000),
    "schedules.faults[].component": text(".+"), "schedules.faults[].kind": text("|".join(FAULTS)), "schedules.faults[].start_s": at_least(0), "schedules.faults[].end_s": above(0),
    "schedules.regimes[].name": text(NAME), "schedules.regimes[].at_s": above(0), "schedules.regimes[].overlay": (lambda v: isinstance(v, dict), "must be a mapping"),
    "run.seed": whole(0), "run.seeds": numbers(whole(0)), "run.window.start": text(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ"), "run.window.duration_hours": above(0), "run.tick_s": whole(1), "run.shard_ticks": whole(1),
    "run.base_rps": above(0), "run.cap_gb": above(0), "run.twin": flag(), "vocab.min_count": whole(1), "slow.quantile": above(0, 1),
}
DEFAULTS = {"schema_version": "1", "mechanism.floor": 0.05, "mechanism.sweep": [0.01, 0.02, 0.05, 0.1, 0.2, 0.5], "run.tick_s": 1, "run.cap_gb": 100.0, "schedules.faults": [], "schedules.regimes": []}
LISTS = ("scenarios", "schedules.faults", "schedules.regimes")

TIERS, QUANTILES, FAILURES = ("bff", "service", "external"), ("p50", "p90", "p95", "p99"), ("4xx", "5xx", "err")
#: The leaves of the constants; each is a mapping with value and source.
CONSTANTS: dict[str, Rule] = {
    **{f"latency_quantiles.{t}.{q}": above(0) for t in TIERS for q in QUANTILES}, **{f"latency_multipliers.{k}": at_least(1) for k in ("degraded", "pool_tight", "pool_exhausted", "cache_cold")},
    "depth_pmf": pmf(), "fanout_pmf_by_depth": numbers(pmf()), **{f"error_rates.{t}.{c}": share() for t in TIERS for c in FAILURES},
    **{f"error_shift.{k}": pmf_by(("ok", *FAILURES)) for k in ("degraded", "failed", "pool_exhausted")}, "retry.p_retry_5xx": share(), "retry.mean_retries": at_least(0), "vocab_size": whole(1),
    **{f"async_gap_quantiles.{q}": above(0) for q in QUANTILES}, "daily_profile": numbers(above(0), 24), "weekday": numbers(above(0), 7), "session.inactivity_gap_min": above(0),
    **{f"session.step_gap_quantiles.{q}": above(0) for q in QUANTILES}, "session.steps_pmf": pmf(), **{f"records_per_request.{k}": at_least(0) for k in ("access", "app_ok", "app_err", "audit")},
    "split.rate": share(), "split.parts_pmf": pmf(), "split.key_part_pmf": pmf(), "split.cut_chars": whole(1), "unattributed_fraction": share(),
    **{f"identity_level_mix.{k}": share() for k in ("session", "device", "user", "ip", "none")},
    **{f"client.{k}": share() for k in ("error_rate", "txn_sampling", "auto_captured_share", "net_flaky_share", "auth_expired_share", "logged_in_share")}, "background.app_lines_per_service_s": at_least(0),
    "cart_fallback_rate": share(), "clock_skew_ms.server_sd": at_least(0), "clock_skew_ms.browser_sd": at_least(0), "health_check_period_s": above(0), "pods_per_service": pmf(),
    **{f"state_dynamics.{k}": share() for k in "load_persist pool_tight_given_high pool_exhausted_given_high cache_cold_given_high cache_persist_cold health_degraded_given_exhausted health_degraded_base health_failed_given_degraded health_recover pool_recover".split()},
    "bytes_per_record.vl": above(0), "bytes_per_record.sentry": above(0), "gzip_ratio": share(),
}


class ConfigError(ValueError):
    """Every problem of a refused configuration: field, value and constraint."""

    def __init__(self, problems: list[dict]):
        self.problems = problems
        super().__init__("\n".join(f"field={p['field']} value={p['value']!r} constraint={p['constraint']}" for p in problems))


def problem(field: str, value, constraint: str) -> dict:
    return {"field": field, "value": value if isinstance(value, (int, float, str, bool)) or value is None else repr(value), "constraint": constraint}


def dig(tree, path: str, default=None):
    """The value at a dotted path."""
    for part in path.split("."):
        if isinstance(tree, list) and part.isdigit() and int(part) < len(tree):
            tree = tree[int(part)]
        elif isinstance(tree, dict) and part in tree:
            tree = tree[part]
        else:
            return default
    return tree


def put(tree: dict, path: str, value) -> None:
    *parts, last = path.split(".")
    for part in parts:
        tree = tree[int(part)] if isinstance(tree, list) else tree.setdefault(part, {})
    tree[last] = value


_MISSING = object()


def _concrete(data: dict) -> dict[str, Rule]:
    """FIELDS with the entries that the lists of ``data`` have."""
    out = {}
    for path, rule in FIELDS.items():
        head, mark, tail = path.partition("[].")
        if not mark:
            out[path] = rule
        for i in range(len(rows) if mark and isinstance(rows := dig(data, head, []), list) else 0):
            out[f"{head}.{i}.{tail}"] = rule
    return out


def _unknown(tree, known: set[str], at: str = "") -> list[str]:
    if at in known or not isinstance(tree, (dict, list)):
        return [] if at in known or at in LISTS else [at]
    steps = tree.items() if isinstance(tree, dict) else enumerate(tree)
    if not tree and (at == "" or at in LISTS or any(k.startswith(f"{at}.") for k in known)):
        return []
    return [x for k, v in steps for x in _unknown(v, known, f"{at}.{k}" if at else str(k))]


def parse(data) -> dict:
    """The configuration with its defaults; raises with all problems."""
    if not isinstance(data, dict):
        raise ConfigError([problem("<root>", data, "configuration must be a mapping")])
    data = copy.deepcopy(data)
    for path, value in DEFAULTS.items():
        parent = dig(data, path.rpartition(".")[0], None) if "." in path else data
        if isinstance(parent, dict) and path.rpartition(".")[2] not in parent or parent is None and path.startswith("schedules"):
            put(data, path, copy.deepcopy(value))
    fields = _concrete(data)
    problems = [problem(p, dig(data, p), "unknown field") for p in _unknown(data, set(fields))]
    for path in LISTS:
        if not isinstance(dig(data, path), list):
            problems.append(problem(path, dig(data, path), "must be a list"))
    for path, (fits, constraint) in fields.items():
        value = dig(data, path, _MISSING)
        if value is _MISSING:
            problems.append(problem(path, None, "is missing"))
        elif not fits(value):
            problems.append(problem(path, value, constraint))
    if not problems:
        problems = cross_problems(data)
    if problems:
        raise ConfigError(problems)
    return data


def window_seconds(config: dict) -> float:
    return config["run"]["window"]["duration_hours"] * 3600.0


def epoch_ms(start: str | datetime) -> int:
    """The window's start in milliseconds; a time without a zone is UTC."""
    at = datetime.fromisoformat(start) if isinstance(start, str) else start
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return int(at.timestamp() * 1000)


def cross_problems(c: dict) -> list[dict]:
    """Problems between fields that are each right on their own."""
    out, counts, run, window = [], c["counts"], c["run"], window_seconds(c)
    say = lambda bad, field, value, constraint: out.append(problem(field, value, constraint)) if bad else None
    names = [s["name"] for s in c["scenarios"]]
    say(len(names) != counts["scenarios"], "scenarios", len(names), f"must contain exactly counts.scenarios ({counts['scenarios']}) entries")
    say(len(set(names)) != len(names), "scenarios", names, "names must be distinct")
    for i, s in enumerate(c["scenarios"]):
        say(s["steps"] > counts["bff_endpoints"], f"scenarios.{i}.steps", s["steps"], f"must be at most counts.bff_endpoints ({counts['bff_endpoints']}): a journey visits distinct ones")
        say(s["fatal_error"] and not s["terminal_failure"], f"scenarios.{i}.terminal_failure", False, "a fatal error needs a terminal failure")
    for i, f in enumerate(c["schedules"]["faults"]):
        at = f"schedules.faults.{i}"
        say(f["end_s"] <= f["start_s"], f"{at}.end_s", f["end_s"], "must be greater than start_s")
        say(f["end_s"] > window, f"{at}.end_s", f["end_s"], f"must be at most the window ({window:g} s)")
        try:
            component(f["component"], counts, c["topology"]["external_services"])
        except ValueError as e:
            out.append(problem(f"{at}.component", f["component"], str(e)))
    ats = [r["at_s"] for r in c["schedules"]["regimes"]]
    say(ats != sorted(set(ats)), "schedules.regimes", ats, "changepoints must be strictly increasing")
    for i, r in enumerate(c["schedules"]["regimes"]):
        say(r["at_s"] >= window, f"schedules.regimes.{i}.at_s", r["at_s"], f"must be below the window ({window:g} s)")
        out += overlay_problems(r["overlay"], i)
    say(len(run["seeds"]) < LEAST_SEEDS or len(set(run["seeds"])) < len(run["seeds"]), "run.seeds", run["seeds"], f"must be at least {LEAST_SEEDS} distinct seeds")
    say(run["seed"] not in run["seeds"], "run.seed", run["seed"], "must be one of run.seeds")
    say(run["shard_ticks"] * run["tick_s"] > window, "run.shard_ticks", run["shard_ticks"], "a shard must not be longer than the window")
    say(c["mechanism"]["floor"] not in c["mechanism"]["sweep"], "mechanism.sweep", c["mechanism"]["sweep"], "must contain the default floor")
    return out


#: What a fault may name: part of the edge, a service or one of its endpoints, an external system.
COMPONENT = re.compile(r"(?P<kind>bff|service|external)(?::(?P<index>\d+))?(?:/endpoint:(?P<endpoint>\d+))?")


def component(reference: str, counts: dict, externals: int) -> tuple[str, int | None, int | None]:
    """(kind, index, endpoint) of a component; raises where it does not exist."""
    m = COMPONENT.fullmatch(reference or "")
    kind, index, endpoint = (m["kind"], m["index"], m["endpoint"]) if m else (None, None, None)
    if m is None or (kind == "bff") != (index is None) or (kind == "external" and endpoint is not None):
        raise ValueError("must be bff | bff/endpoint:<j> | service:<i> | service:<i>/endpoint:<j> | external:<i>")
    limits = {"bff": (1, counts["bff_endpoints"]), "service": (counts["services"], counts["endpoints_per_service"]), "external": (externals, 1)}[kind]
    for name, value, limit in (("index", index, limits[0]), ("endpoint", endpoint, limits[1])):
        if value is not None and int(value) >= limit:
            raise ValueError(f"{kind} {name} must be below {limit}")
    return kind, None if index is None else int(index), None if endpoint is None else int(endpoint)


def overlay_problems(overlay: dict, index: int) -> list[dict]:
    """Problems of what a regime changes: constants and the multiplier of error rates, nothing else."""
    at, out = f"schedules.regimes.{index}.overlay", []
    for key in set(overlay) - {"constants", "mechanism"}:
        out.append(problem(f"{at}.{key}", overlay[key], "only constants and mechanism can change"))
    for path, value in (overlay.get("constants") or {}).items():
        rule = CONSTANTS.get(path)
        if rule is None or not rule[0](value):
            out.append(problem(f"{at}.constants.{path}", value, rule[1] if rule else "not a known constant"))
    for key, value in (overlay.get("mechanism") or {}).items():
        if key != "error_rate_multiplier" or not (_number(value) and value > 0):
            out.append(problem(f"{at}.mechanism.{key}", value, "only a positive error_rate_multiplier can change"))
    return out


def apply_overlay(config: dict, constants: Constants, overlay: dict) -> tuple[dict, Constants]:
    """Configuration and constants of a regime; the given ones stay as they are."""
    config, payload = copy.deepcopy(config), copy.deepcopy(constants.payload)
    for path, value in (overlay.get("constants") or {}).items():
        leaf = dig(payload["leaves"], path)
        leaf |= {"value": value, "note": f"{leaf.get('note') or ''} [regime]".strip()}
    config["mechanism"] |= overlay.get("mechanism") or {}
    return config, Constants(payload)


def regimes(config: dict) -> list[tuple[str, float, float]]:
    """(name, start_s, end_s) over the whole window; what comes before the first changepoint is 'base'."""
    points = [("base", 0.0), *((r["name"], float(r["at_s"])) for r in config["schedules"]["regimes"])]
    ends = [at for _, at in points[1:]] + [window_seconds(config)]
    return [(name, start, end) for (name, start), end in zip(points, ends)]


class Constants:
    """Fitted constants by dotted path; raises with all problems of the file."""

    def __init__(self, payload: dict):
        problems = [problem(k, None, "is missing") for k in ("version", "fitted_at", "sources", "leaves") if k not in payload]
        self.payload, self.values = payload, {}
        for path, (fits, constraint) in CONSTANTS.items() if not problems else ():
            leaf = dig(payload["leaves"], path)
            if not isinstance(leaf, dict) or "value" not in leaf or "source" not in leaf:
                problems.append(problem(path, None, "must be a leaf with value and source"))
                continue
            if leaf["source"] not in payload["sources"]:
                problems.append(problem(path, leaf["source"], "is a source that is not declared"))
            if not fits(leaf["value"]):
                problems.append(problem(path, leaf["value"], constraint))
            self.values[path] = leaf["value"]
        if problems:
            raise ConfigError(problems)
        self.version = str(payload["version"])

    def __getitem__(self, path: str):
        return self.values[path]

    def get(self, path: str, default=None):
        return self.values.get(path, default)

    def quantiles(self, tier: str) -> list[float]:
        return [self[f"latency_quantiles.{tier}.{q}"] for q in QUANTILES]

    def error_rates(self, tier: str) -> dict[str, float]:
        return {c: self[f"error_rates.{tier}.{c}"] for c in FAILURES}


def read_mapping(path: str):
    """A JSON file, or YAML where a reader for it is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise ConfigError([problem("<file>", path, "YAML can't be read here; give JSON")]) from e
        try:
            return yaml.safe_load(f)
        except yaml.YAMLError as e:
            raise ConfigError([problem("<file>", path, f"not valid YAML: {e}")]) from e


def load(path: str) -> dict:
    return parse(read_mapping(path))


def resolve(config_path: str, named: str) -> str:
    """The file that a configuration names: relative to its own folder or to the nearest folder above that has it."""
    folder = os.path.dirname(os.path.abspath(config_path))
    while not os.path.exists(found := os.path.join(folder, named)):
        if folder == os.path.dirname(folder):
            raise FileNotFoundError(named)
        folder = os.path.dirname(folder)
    return found


def load_constants(path: str) -> Constants:
    return Constants(read_mapping(path))


def sample_family(family: dict) -> list[tuple[dict, str]]:
    """Systems of a family, each with 'train' or 'test': sizes are drawn within ranges, and a size that was drawn for one system is not
    drawn for another, so no test system repeats a training one. ``family``: n_systems, seed, ranges, split.test_fraction, template."""
    import numpy as np

    rng, seen, out = np.random.default_rng(family["seed"]), set(), []
    n_test = max(1, round(family["n_systems"] * family["split"]["test_fraction"]))
    for i in range(family["n_systems"]):
        for _ in range(1000):
            r = {k: (rng.uniform(v["lo"], v["hi"]) if isinstance(v["lo"], float) else int(rng.integers(v["lo"], v["hi"] + 1))) for k, v in family["ranges"].items()}
            key = tuple(sorted((k, round(v, 6)) for k, v in r.items()))
            if key not in seen:
                break
        else:
            raise ConfigError([problem("ranges", family["ranges"], f"too narrow for {family['n_systems']} distinct systems")])
        seen.add(key)
        c = copy.deepcopy(family["template"])
        c["name"] = f"{family['name']}-{i}"
        c["counts"] = {k: r[k] for k in ("clients", "services", "endpoints_per_service", "bff_endpoints", "scenarios")}
        c.setdefault("topology", {})["fanout_mean"] = float(r["fanout_mean"])
        base = c["scenarios"][0]
        c["scenarios"] = [{**copy.deepcopy(base), "name": f"s{k}-{base['name']}"[:32], "steps": min(r["steps"], r["bff_endpoints"]), "weight": float(k + 1)} for k in range(r["scenarios"])]
        out.append((c, "test" if i >= family["n_systems"] - n_test else "train"))
    return out
