"""A small system made, simulated, correlated and scored; the mechanism and its projection by other means."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopwright import config as C
from hopwright import topology as T
from hopwright.functions import ids
from hopwright.operators import evaluation, feed, graphs, latents, mechanism, projection, report, resolve, sequences, series, simulate, views
from hopwright.sources import corpus, registry


def leaf(value):
    return {"value": value, "source": "made"}


def constants(**changed):
    q = {"p50": 0.01, "p90": 0.03, "p95": 0.05, "p99": 0.2}
    fails = {"4xx": 0.02, "5xx": 0.02, "err": 0.01}
    values = {
        **{f"latency_quantiles.{t}.{k}": v for t in C.TIERS for k, v in q.items()}, **{f"latency_multipliers.{k}": 2.0 for k in ("degraded", "pool_tight", "pool_exhausted", "cache_cold")},
        "depth_pmf": [0.6, 0.4], "fanout_pmf_by_depth": [[0.5, 0.5]], **{f"error_rates.{t}.{k}": v for t in C.TIERS for k, v in fails.items()},
        "error_shift.degraded": {"ok": 0.7, "4xx": 0.0, "5xx": 0.2, "err": 0.1}, "error_shift.failed": {"ok": 0.05, "4xx": 0.05, "5xx": 0.6, "err": 0.3}, "error_shift.pool_exhausted": {"ok": 0.6, "4xx": 0.0, "5xx": 0.3, "err": 0.1},
        "retry.p_retry_5xx": 0.6, "retry.mean_retries": 0.1, "vocab_size": 50, **{f"async_gap_quantiles.{k}": 1.0 + i for i, k in enumerate(q)}, "daily_profile": [1.0] * 24, "weekday": [1.0] * 7,
        "session.inactivity_gap_min": 30.0, **{f"session.step_gap_quantiles.{k}": 2.0 + i for i, k in enumerate(q)}, "session.steps_pmf": [0.5, 0.5], "records_per_request.access": 1.0, "records_per_request.app_ok": 0.5,
        "records_per_request.app_err": 2.0, "records_per_request.audit": 0.5, "split.rate": 0.3, "split.parts_pmf": [0.0, 0.7, 0.3], "split.key_part_pmf": [0.6, 0.4], "split.cut_chars": 4000, "unattributed_fraction": 0.01,
        **{f"identity_level_mix.{k}": 0.2 for k in ("session", "device", "user", "ip", "none")}, "client.error_rate": 0.01, "client.txn_sampling": 0.4, "client.auto_captured_share": 0.3, "client.net_flaky_share": 0.1,
        "client.auth_expired_share": 0.05, "client.logged_in_share": 0.7, "background.app_lines_per_service_s": 0.01, "cart_fallback_rate": 0.1, "clock_skew_ms.server_sd": 0.0, "clock_skew_ms.browser_sd": 5.0,
        "health_check_period_s": 60.0, "pods_per_service": [0.5, 0.5], "state_dynamics.load_persist": 0.9, "state_dynamics.pool_tight_given_high": 0.2, "state_dynamics.pool_exhausted_given_high": 0.1,
        "state_dynamics.cache_cold_given_high": 0.1, "state_dynamics.cache_persist_cold": 0.8, "state_dynamics.health_degraded_given_exhausted": 0.2, "state_dynamics.health_degraded_base": 0.01,
        "state_dynamics.health_failed_given_degraded": 0.1, "state_dynamics.health_recover": 0.2, "state_dynamics.pool_recover": 0.2, "bytes_per_record.vl": 900.0, "bytes_per_record.sentry": 600.0, "gzip_ratio": 0.1, **changed,
    }
    leaves = {}
    for path, v in values.items():
        C.put(leaves, path, leaf(v))
    return {"version": "t", "fitted_at": "2026-01-01", "sources": {"made": "by hand"}, "leaves": leaves}


def config(**changed):
    out = {
        "name": "tiny", "rung": "local", "constants": "none", "counts": {"clients": 8, "services": 2, "endpoints_per_service": 2, "bff_endpoints": 2, "scenarios": 2},
        "scenarios": [
            {"name": "browse", "steps": 1, "weight": 2.0, "repertoire": {"client": ["ok", "err"], "bff": ["ok", "4xx", "5xx", "err", "slow"]}, "retry": {"max_retries": 1, "retry_on": ["5xx", "err"]}, "fatal_error": True, "terminal_failure": True},
            {"name": "purchase", "steps": 2, "weight": 1.0, "repertoire": {"client": ["ok", "err"], "bff": ["ok", "5xx", "err"]}, "retry": {"max_retries": 0, "retry_on": []}, "fatal_error": False, "terminal_failure": False},
        ],
        "endpoints": {"repertoire": ["ok", "4xx", "5xx", "err", "slow"], "retry": {"max_retries": 1, "retry_on": ["5xx"]}},
        "topology": {"depth_pmf": [0.6, 0.4], "fanout_mean": 1.5, "external_services": 1, "criticality_share": 0.7, "cache_hit_share": 0.5},
        "mechanism": {"error_rate_multiplier": 1.0, "ctxmax": True, "mc_samples": 2000},
        "schedules": {"faults": [{"component": "service:0", "kind": "crash", "start_s": 120, "end_s": 200}], "regimes": [{"name": "worse", "at_s": 300, "overlay": {"mechanism": {"error_rate_multiplier": 2.0}}}]},
        "run": {"seed": 0, "seeds": [0, 1, 2, 3, 4], "window": {"start": "2026-01-05T09:00:00Z", "duration_hours": 0.1}, "shard_ticks": 180, "base_rps": 0.6, "twin": False}, "vocab": {"min_count": 2}, "slow": {"quantile": 0.95},
    }
    for path, value in changed.items():
        C.put(out, path.replace("__", "."), value)
    return out


@pytest.fixture(scope="module")
def plant():
    c, k = C.parse(config()), C.Constants(constants())
    system = T.sample_system(c, k, 0)
    return simulate.Plant(system, c, k, mechanism.Latency(system, c, k, 0), 0)


@pytest.fixture(scope="module")
def made(spark, plant, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('corpus')}/c"
    records, spans, sessions = simulate.corpus(spark, plant)
    registry.write_shards(records, spans.withColumn("shard", F.floor(F.col("start_ms") / 180_000)), sessions, root)
    return root


@pytest.mark.parametrize(
    "changed, field",
    [
        ({"counts__services": 0}, "counts.services"), ({"bogus": 1}, "bogus"), ({"scenarios__0__steps": 3}, "scenarios.0.steps"), ({"run__seed": 9}, "run.seed"), ({"run__shard_ticks": 10_000}, "run.shard_ticks"),
        ({"schedules__faults__0__component": "service:2"}, "schedules.faults.0.component"), ({"schedules__faults__0__component": "external:0/endpoint:1"}, "schedules.faults.0.component"), ({"mechanism__floor": 0.3}, "mechanism.sweep"),
        ({"schedules__regimes__0__overlay": {"constants": {"nope": 1}}}, "schedules.regimes.0.overlay.constants.nope"), ({"topology__depth_pmf": [0.5, 0.4]}, "topology.depth_pmf"), ({"scenarios__0__terminal_failure": False}, "scenarios.0.terminal_failure"),
    ],
)
def test_configurations_are_refused(changed, field):
    bad = config()
    for path, value in changed.items():
        steps = path.split("__")
        C.put(bad, ".".join(steps), value) if not any(s.isdigit() for s in steps) else put(bad, steps, value)
    with pytest.raises(C.ConfigError) as e:
        C.parse(bad)
    assert field in {p["field"] for p in e.value.problems}


def put(tree, steps, value):
    for s in steps[:-1]:
        tree = tree[int(s) if s.isdigit() else s]
    tree[steps[-1]] = value


def test_constants_regimes_and_families(tmp_path):
    with pytest.raises(C.ConfigError):
        C.Constants(constants(**{"split.rate": 1.5}))
    c, k = C.parse(config()), C.Constants(constants())
    assert C.regimes(c) == [("base", 0.0, 300.0), ("worse", 300.0, 360.0)]
    later, changed = C.apply_overlay(c, k, {"constants": {"split.rate": 0.9}, "mechanism": {"error_rate_multiplier": 2.0}})
    assert changed["split.rate"] == 0.9 and later["mechanism"]["error_rate_multiplier"] == 2.0 and k["split.rate"] == 0.3 and c["mechanism"]["error_rate_multiplier"] == 1.0
    ranges = {**{n: {"lo": 1, "hi": 6} for n in ("clients", "services", "endpoints_per_service", "bff_endpoints", "scenarios", "steps")}, "fanout_mean": {"lo": 1.0, "hi": 2.0}}
    family = C.sample_family({"name": "fam", "n_systems": 6, "seed": 3, "ranges": ranges, "split": {"test_fraction": 0.3}, "template": {k: v for k, v in config(schedules={"faults": [], "regimes": []}).items() if k not in ("name", "counts")}})
    assert [s for _, s in family].count("test") == 2 and all(C.parse(f)["name"] for f, _ in family)
    assert C.epoch_ms("2026-01-05T09:00:00") == C.epoch_ms("2026-01-05T09:00:00Z") == 1767603600000
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "k.json").write_text("{}")
    assert C.resolve(str(tmp_path / "a" / "b" / "c.json"), "k.json") == str(tmp_path / "k.json")


def test_ids_are_fixed(spark):
    import hashlib

    assert ids.stable_hex("split", 7) == hashlib.blake2b(b"split\x1f7\x1f", digest_size=16).hexdigest()
    row = spark.range(7, 8).select(ids.hex_id(32, F.lit("split"), F.col("id")), ids.uuid_id(F.lit("a")), ids.split_of(F.col("id"))).first()
    bucket = int(ids.stable_hex("split", 7)[:8], 16) % 100
    assert row[0] == ids.stable_hex("split", 7) and row[1] == ids.stable_uuid("a") and row[2] == ("train" if bucket < 80 else "val" if bucket < 90 else "test")
    assert ids.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    with pytest.raises(ValueError):
        ids.canonical_json({"a": float("nan")})


def test_a_system_is_layered_and_reached(plant):
    s = plant.system
    assert all(s.ops[c.caller].depth < s.ops[c.callee].depth for c in s.calls)
    assert {o.id for o in s.of_kind(T.SERVICE)} <= {v for o in s.of_kind(T.EDGE) for v in s.reach(o.id)}
    assert s.calibration["tv"] < 0.05 and all(T.LEAST_CALL <= c.p_call <= 1 for c in s.calls)
    assert sum(x.weight for x in s.scenarios) == pytest.approx(1) and T.largest_remainder([1, 1, 1], 5) == [2, 2, 1]
    import re

    assert all(re.fullmatch(T.GRAMMAR["service"], x.name) and all(re.fullmatch(T.GRAMMAR["pod"], p) for p in x.pods) for x in s.services)
    again = T.sample_system(plant.config, plant.constants, 0)
    assert registry.same_instance(registry.instantiation(plant.config, s, 0, "t"), registry.instantiation(plant.config, again, 0, "t")) == []
    other = registry.instantiation(plant.config, T.sample_system(plant.config, plant.constants, 1), 1, "t")
    assert len(registry.same_instance(registry.instantiation(plant.config, s, 0, "t"), other)) == 2


def test_stationary_and_tables(plant):
    k = plant.constants
    for rows in (*mechanism.load_rows(k), *mechanism.pool_rows(k), *mechanism.cache_rows(k), *mechanism.health_rows(k)):
        p = mechanism.stationary(rows)
        assert np.allclose(rows.sum(axis=1), 1) and np.allclose(p @ rows, p, atol=1e-10)
    assert all(np.allclose(r.sum(axis=-1), 1) for r in mechanism.class_rows(k, 3.0).values())


@pytest.fixture(scope="module")
def net(plant):
    return mechanism.build(plant.system, plant.config, plant.constants, plant.latency)


def test_effects_by_all_assignments(net, plant):
    p = projection.Projector(net, frozenset(), "request")
    checked = 0
    for source in (*p.tokens, *p.hidden):
        for end in p.ends(source)[0]:
            chain = p.chain(source, end)
            if end == source or not 0 < len(chain) <= 3 or checked >= 25:
                continue
            value = net.nodes[source].values[-1]
            want = np.zeros(len(net.nodes[end].values))
            for xs in itertools.product(*(net.nodes[n].values for n in chain)):
                assigned, weight = {source: value}, 1.0
                for n, x in zip(chain, xs):
                    weight *= net.distribution(n, net.context(n, assigned))[net.nodes[n].values.index(x)]
                    assigned[n] = x
                want += weight * net.distribution(end, net.context(end, assigned))
            assert np.allclose(p.effect(source, value, end).chances, want / want.sum(), atol=1e-8)
            checked += 1
    assert checked > 10


def test_sampled_effects_are_near_the_exact_ones(net):
    exact, few = projection.Projector(net), projection.Projector(net, most=0, samples=4000)
    pairs = [(h, e) for h in exact.hidden for e in exact.ends(h)[0] if exact.chain(h, e)][:6]
    for h, e in pairs:
        a, b = exact.effect(h, net.nodes[h].values[-1], e), few.effect(h, net.nodes[h].values[-1], e)
        assert b.samples == 4000 and a.samples == 0 and np.abs(a.chances - b.chances).max() < 6 * b.error + 1e-6


def test_strengths_by_simulation(net, plant):
    # A failed edge endpoint against a healthy one, all else nominal: what the mechanism says and what requests come to.
    edge = plant.system.of_kind(T.EDGE)[0].id
    scenario, step = next((s.index, j) for s in plant.system.scenarios for j, (_, e) in enumerate(s.steps) if e == edge)
    got = simulate.forced_effect(plant, edge, [0, 2], latents.HEALTH, edge)
    node, health = f"T:bff:{scenario}:{step}:0", f"health:{edge}"
    failed = net.distribution(node, net.context(node, {health: "failed"}))
    assert abs((got[1][1:4].sum()) - failed[1:4].sum()) < 0.05 and got[1][1:4].sum() > got[0][1:4].sum() + 0.3


def test_held_variables_act_as_the_mechanism_says(net, plant):
    system = plant.system
    call = next(c for c in system.calls if system.ops[c.caller].kind == T.EDGE and system.ops[c.callee].kind == T.SERVICE and c.critical)
    edge, inner = call.caller, call.callee
    scenario, step = next((s.index, j) for s in system.scenarios for j, (_, e) in enumerate(s.steps) if e == edge)
    node = f"T:bff:{scenario}:{step}:0"
    got = simulate.forced(plant, edge, "T", {f"F:{inner}": "err"})
    want = net.distribution(node, net.context(node, {f"F:{inner}": "err"}))
    assert abs(got[1:4].sum() - want[1:4].sum()) < 0.06
    assert simulate.forced(plant, edge, f"I:{inner}", {f"I:{inner}": "absent"})[0] == 0 and simulate.forced(plant, edge, f"I:{inner}", {f"I:{inner}": "present"})[0] == 1
    again = simulate.forced(plant, edge, f"A:{inner}:1", {f"A:{inner}:0": "5xx"})
    assert abs(1 - again[5] - plant.constants["retry.p_retry_5xx"]) < 0.02


def test_artifacts_and_changepoints(spark, net, plant, tmp_path):
    counts = projection.write_artifacts(spark, plant, net, "twin", f"file://{tmp_path}")
    assert counts["request-bidirected"] == 0 and counts["request-directed"] > 0 and counts["changepoints"] > 0 and counts["floors"] == 6 and counts["mechanism"] == len(net.edges())
    assert counts["request-support"] <= counts["session-support"] and counts["alphabet"] > 30 and projection.hidden_groups("metrics") == ["auth", "cache", "net"]
    changed = spark.read.parquet(f"{tmp_path}/graphs/changepoints")
    assert {(r.regime, r.at_s) for r in changed.select("regime", "at_s").distinct().collect()} == {("worse", 300.0)}


def test_target_scores_perfectly_against_itself(spark, net, plant):
    request = spark.createDataFrame(sorted(T.support(plant.system)), "op_a int, op_b int")
    assert T.support(plant.system) <= T.support(plant.system, "session")
    directed, both, within = projection.target(spark, projection.Projector(net), request)
    rounds = lambda df: spark.createDataFrame(df.collect(), df.schema)
    directed, both = rounds(directed), rounds(both)
    assert directed.count() > 10 and both.count() > 5 and within.filter("src is null").count() == 0
    rows = [(t["token"], t["op_id"]) for t in T.alphabet(plant.system, plant.config["endpoints"]["repertoire"])]
    pairs = evaluation.universe(spark.createDataFrame(rows, "token string, op int"), request, directed)
    target = evaluation.Graph(directed, both)
    assert evaluation.self_check(target, pairs) == []
    worse = evaluation.score(target, evaluation.Graph(directed.limit(0).withColumn("score", F.lit(1.0)), both.limit(0).withColumn("score", F.lit(1.0))), pairs)
    assert worse["directed"]["recall"] == 0 and worse["shd_mixed"] > 0 and worse["baselines"]["shd_empty_directed"] == worse["directed"]["fn"]
    assert worse["causal_validity"]["value"] is None and "hides" in worse["causal_validity"]["reason"]
    assert projection.exposure(exposed=["intensity", "load", "pool", "health"])[0] == "metrics" and projection.exposure("twin")[1] == set(mechanism.GROUPS)
    with pytest.raises(ValueError):
        projection.exposure(exposed=["weather"])


def test_shown_states_become_sources(net):
    twin = projection.Projector(net, frozenset(mechanism.GROUPS))
    assert not twin.hidden and twin.token("health:0", "failed") == "state:health:0=failed" and projection.Projector(net).token("health:0", "failed") is None
    assert all(c in twin.ends(twin.shown[0])[0] or c in twin.between for c in twin.children[twin.shown[0]])


def test_every_record_has_its_truth(spark, plant, made):
    sessions = simulate.arrivals(spark, plant)
    emitter = simulate.Emitter(plant)
    rows = emitter.named(simulate.traffic(plant, sessions.limit(40), simulate.states_by_shard(plant, simulate.states(spark, plant))), sessions)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    records = emitter.records(spark, rows)
    linkage = emitter.oracle_linkage(rows, records)
    assert linkage.count() == records.count()
    lost = linkage.filter("session_gid is null").select("log_id").join(records, "log_id").filter("coalesce(path, '') <> '/healthz' AND coalesce(message, '') <> '[Scheduler] tick'")
    assert lost.count() == 0
    shown = emitter.with_states(emitter.access(rows.filter("client_op is null")), rows)
    assert {r.state_health for r in shown.select("state_health").distinct().collect()} <= set(mechanism.VALUES["health"])
    assert emitter.state_events(simulate.states(spark, plant)).filter("value = previous").count() == 0


def test_arrivals_and_states(spark, plant):
    sessions = simulate.arrivals(spark, plant)
    n = sessions.count()
    expected = simulate.estimate(plant)["sessions"]
    assert abs(n - expected) < 5 * expected**0.5 and sessions.select("gid").distinct().count() == n
    assert sessions.filter("arrival_ms < arrival_tick * 1000 OR arrival_ms >= (arrival_tick + 1) * 1000").count() == 0
    states = simulate.states(spark, plant)
    assert states.count() == plant.ticks * (3 * 4 + 2 + 4 + 1)
    fault = simulate.faults(plant)[0]
    held = states.filter(F.col("variable") == latents.HEALTH).filter(F.col("slot").isin(fault["causes"])).filter("tick >= 120 AND tick < 200")
    assert held.filter("value <> 2").count() == 0 and held.count() == 80 * len(fault["causes"])


def test_the_whole_way_from_a_configuration_to_a_report(spark, plant, made):
    assert sorted(map(int, corpus.completed_shards(spark, made))) == [0, 1] and registry.pending_shards(spark, made, [0, 1, 2]) == [2]
    records = corpus.read_feed(spark, made)
    oracle = spark.read.parquet(f"{made.removeprefix('file://')}/oracle/spans")
    spans = spark.createDataFrame(*(lambda df: (df.collect(), df.schema))(feed.normalise(records)))
    assert {r.kind for r in spans.select("kind").distinct().collect()} == {"vl.access", "vl.app", "vl.audit", "sentry.error", "sentry.transaction"}
    own, ties = resolve.identities(spans), resolve.connectors(spans)
    attribution = resolve.attribute(spans, own, ties, resolve.resolve(own, ties))
    frames = T.frames(spark, plant.system)
    hops = resolve.containment_parents(resolve.trace_hops(spans, frames["services"].filter("ip <> ''").select("ip", F.col("name").alias("service"))))
    hops = spark.createDataFrame(hops.collect(), hops.schema)
    links = {r.kind: r for r in report.link_confusion(oracle, hops).collect()}
    assert links["all"].f1 > 0.97 and links["edge"].tp == 0 and links["edge"].fp == 0 and links["all"].tp == links["internal"].tp
    loss = report.losses(spans, attribution, resolve.client_links(spans), hops).first()
    assert loss.unattributed_fraction < 0.3 and 0 < loss.client_error_linked_fraction < 1
    assert report.feed_counts(spans).first().cart_fallbacks > 0
    rows = [(t["token"], t["op_id"], t["service"], t["name"], t["kind"]) for t in T.alphabet(plant.system, plant.config["endpoints"]["repertoire"])]
    ops = views.op_index(spark.createDataFrame(rows, "token string, op_id int, service string, name string, kind int"))
    thresholds = spark.createDataFrame([(o, float(t)) for o, t in plant.latency.threshold.items()], "op int, threshold_s double")
    built = views.build_spans(spans, hops, attribution, ops, thresholds, resolve.client_links(spans))
    truth = {r.span_id: r.op for r in oracle.collect()}
    assert all(truth[r.span_id] == r.op for r in built.filter("kind = 'hop'").collect())
    end = views.request_rows(built, hops, attribution, "end")
    end = spark.createDataFrame(end.collect(), end.schema)
    traces = {r.trace_id for r in hops.select("trace_id").collect()}
    assert {r.trace_id for r in end.collect()} == traces and views.orientation(end, "end").first().rate < 0.1
    counted = views.row_counts(end.select(F.lit("end").alias("ordering"), F.lit("request").alias("grain"), "split"))
    assert counted.count() == 12 and counted.agg(F.sum("rows")).first()[0] == len(traces)
    vocabulary = views.vocabulary(views.token_counts(end), plant.config["vocab"]["min_count"])
    assert vocabulary.count() > 0 and vocabulary.filter("outcome = 0").count() == 0
    registry_problems = registry.name_problems(records, deny=["scheduler.lua"])
    assert {r.problem for r in registry_problems.collect()} == {"denied name"}
    statistics = series.realism(oracle.withColumn("parent_hop", F.col("parent")), frames["ops"].withColumn("leaf", F.col("kind") == T.EXTERNAL), 2, least=1)
    assert statistics["latency"].filter("p50 is null").count() == 0 and 0 < statistics["retries"].first()[0] < 0.2


def test_sessions_are_recovered(spark, plant, made):
    oracle = spark.read.parquet(f"{made.removeprefix('file://')}/oracle/spans").select("span_id", "session_gid")
    spans = feed.normalise(corpus.read_feed(spark, made))
    own, ties = resolve.identities(spans), resolve.connectors(spans)
    found = resolve.attribute(spans, own, ties, resolve.resolve(own, ties)).filter("level = 0")
    runs = sequences.with_runs(found.join(spans.select("span_id", "ts_ms"), "span_id"), ["key"], "ts_ms", "span_id").select("span_id", F.concat_ws("|", "key", "run").alias("sequence"))
    got = report.recovery_summary(oracle.join(runs, "span_id", "left"), "session_gid", "sequence").first()
    assert got.mean_jaccard > 0.8 and got.merge_rate == 0 and got.true_sessions > 50


def test_metrics_of_a_variant(spark, plant):
    frames = T.frames(spark, plant.system)
    _, shown = projection.exposure("metrics")
    listed = series.catalogue(frames["services"], frames["ops"], sorted(shown)).collect()
    backend = [s for s in plant.system.services if s.kind != T.CLIENT]
    assert len(listed) == 1 + 2 * len(backend) + len(plant.system.of_kind(T.EDGE, T.SERVICE, T.EXTERNAL)) and [r.family for r in listed] == sorted(r.family for r in listed)
    assert series.scrape_ticks(1, 180) == 30
    for bad in ((7, 180), (1, 100)):
        with pytest.raises(ValueError):
            series.scrape_ticks(*bad)
    assert series.tolerance_ok(0.005, 0) and not series.tolerance_ok(0.02, 0) and series.tolerance_ok(1.05, 1) and series.tolerance_ok(None, 1) is None


def test_steps_stop_at_the_first_failure():
    log = registry.run_steps([("a", lambda: {"n": 1}), ("b", lambda: 1 / 0), ("c", dict)])
    assert [(x["step"], x["status"]) for x in log] == [("a", "ok"), ("b", "failed"), ("c", "not run")] and log[0]["n"] == 1 and "ZeroDivisionError" in log[1]["error"]
    assert registry.derivable(True, "latent", "latent", (0, 3), (0, 3), []) == [] and len(registry.derivable(False, "twin", "latent", (0, 2), (0, 3), ["x"])) == 4
    with pytest.raises(ValueError):
        registry.within_cap(11.0, 10.0)


def test_plans_refuse_and_freeze(spark):
    files = spark.createDataFrame([("a", "p", 1, "x"), ("b", "p", 1, "y")], "corpus string, path string, bytes long, sha256 string")
    with pytest.raises(ValueError):
        registry.upload_plan(files, "to")
    one = spark.createDataFrame([("a", "1", "c"), ("b", "1", "c")], "corpus string, tool_version string, constants_version string")
    assert registry.freeze(one, files).count() == 2
    with pytest.raises(ValueError):
        registry.freeze(one.union(spark.createDataFrame([("c", "2", "c")])), files)
    assert registry.trie_pattern(["ab", "ac", "a.b"]) == "a(?:\\.b|b|c)"


def test_manifest_and_verification(spark, made, tmp_path):
    listed = corpus.manifest(spark, made).collect()
    manifest = spark.createDataFrame(listed)
    assert registry.verify(spark, made, manifest).count() == 0
    short = manifest.filter(~F.col("path").endswith(".done"))
    assert {r.problem for r in registry.verify(spark, made, short).collect()} == {"unlisted"}
    registry.write_json(spark, f"file://{tmp_path}/x.json", {"b": [1], "a": None})
    assert (tmp_path / "x.json").read_text() == '{\n "a": null,\n "b": [\n  1\n ]\n}\n'
    with pytest.raises(PermissionError):
        corpus.open_for_method(spark, made, "oracle/spans")
    assert registry.link_or_copy(str(tmp_path / "x.json"), str(tmp_path / "y" / "x.json")) in ("linked", "copied")
