"""Scoring a predicted mixed graph against a target: universe, every structural axis, baselines, floors, self-check.

Graphs are DataFrames: ``directed`` (src, dst, strength or score) and ``bidirected`` (a, b, strength or score). The universe is the
ordered pairs of tokens whose operations can occur together; predictions outside it are counted and not scored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwright.operators import graphs, scoring

DEFAULT_FLOOR = 0.05
#: The floors of the sensitivity sweep.
FLOORS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5)


@dataclass
class Graph:
    directed: DataFrame
    bidirected: DataFrame


def universe(tokens: DataFrame, support: DataFrame, directed: DataFrame) -> DataFrame:
    """(src, dst): ordered pairs that can be scored. ``tokens``: token, op (null for state tokens)."""
    pairs = graphs.token_universe(tokens, support.filter("op_a <> op_b"))
    return pairs.unionByName(graphs.state_universe(tokens.filter("op is null"), tokens.filter("op is not null"), directed)).distinct()


def unordered(pairs: DataFrame) -> DataFrame:
    return scoring.undirected(pairs, "src", "dst")


def at_floor(target: Graph, floor: float) -> Graph:
    """The target's edges of at least that strength."""
    return Graph(target.directed.filter(F.col("strength") >= floor), target.bidirected.filter(F.col("strength") >= floor))


def prediction(directed: DataFrame, bidirected: DataFrame, order: str = "at") -> Graph:
    """Predicted edges with repeats overwritten by the later one, bidirected ones with the smaller end first; a missing score is 1."""
    both = bidirected.withColumns({"__a": F.least("a", "b"), "__b": F.greatest("a", "b")}).drop("a", "b").withColumnsRenamed({"__a": "a", "__b": "b"})
    return Graph(scoring.keep_last(directed, ["src", "dst"], order), scoring.keep_last(both, ["a", "b"], order))


def as_prediction(target: Graph, floor: float = DEFAULT_FLOOR) -> Graph:
    """The target itself, predicted with its strengths as scores."""
    own = at_floor(target, floor)
    return Graph(own.directed.select("src", "dst", F.col("strength").alias("score")), own.bidirected.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("strength").alias("score")))


def inside(predicted: Graph, pairs: DataFrame) -> Graph:
    """The predicted edges that lie in the universe."""
    un = unordered(pairs)
    return Graph(predicted.directed.join(pairs, ["src", "dst"], "left_semi"), predicted.bidirected.join(un, ["a", "b"], "left_semi"))


def outside_count(predicted: Graph, pairs: DataFrame) -> int:
    un = unordered(pairs)
    return predicted.directed.join(pairs, ["src", "dst"], "left_anti").count() + predicted.bidirected.join(un, ["a", "b"], "left_anti").count()


def skeleton(graph: Graph) -> DataFrame:
    ends = graph.bidirected.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return scoring.undirected(graph.directed, "src", "dst").unionByName(ends).distinct()


def orientation(target: Graph, predicted: Graph, compelled: DataFrame | None = None) -> DataFrame:
    """n, correct and accuracy of the directions of skeleton edges that both have, where the truth has one direction and no
    bidirected edge; n_compelled and accuracy_compelled of those that ``compelled`` (src, dst, compelled) marks."""
    d = target.directed.select("src", "dst").distinct()
    back = d.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ends = lambda df: df.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    single = ends(d.join(back, ["src", "dst"], "left_anti")).join(target.bidirected.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    met = single.join(skeleton(predicted), ["a", "b"], "left_semi")
    p = predicted.directed.select("src", "dst").distinct()
    hit = met.join(p.withColumn("there", F.lit(True)), ["src", "dst"], "left")
    hit = hit.join(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back")), ["src", "dst"], "left")
    if compelled is None:
        hit = hit.withColumn("compelled", F.lit(False))
    else:
        hit = hit.join(compelled.filter("compelled").select("src", "dst", F.lit(True).alias("compelled")), ["src", "dst"], "left")
    ok = F.col("there").isNotNull() & F.col("back").isNull()
    forced = F.coalesce("compelled", F.lit(False))
    out = hit.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("correct"), F.count_if(forced).alias("n_compelled"), F.count_if(ok & forced).alias("correct_compelled"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return out.withColumns({"accuracy": ratio("correct", "n"), "accuracy_compelled": ratio("correct_compelled", "n_compelled")})


def scored_universe(pairs: DataFrame, truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Every pair with whether it is true and its score; a pair that isn't predicted has 0, as one predicted with 0."""
    t = truth.select(*keys).distinct().withColumn("y", F.lit(True))
    p = predicted.groupBy(*keys).agg(F.max("score").alias("score"))
    return pairs.join(t, keys, "left").join(p, keys, "left").select(F.concat_ws("\t", *keys).alias("pair"), F.coalesce("y", F.lit(False)).alias("y"), F.coalesce("score", F.lit(0.0)).alias("score"))


def ranks(pairs: DataFrame, target: Graph, predicted: Graph) -> DataFrame:
    """AUROC and average precision of the directed, skeleton and bidirected axes: axis, auroc, average_precision."""
    un = unordered(pairs)
    d = predicted.directed.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "score")
    axes = {
        "directed": scored_universe(pairs, target.directed, predicted.directed, ["src", "dst"]),
        "skeleton": scored_universe(un, skeleton(target), d.unionByName(predicted.bidirected.select("a", "b", "score")), ["a", "b"]),
        "bidirected": scored_universe(un, target.bidirected.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), predicted.bidirected, ["a", "b"]),
    }
    out = None
    for axis, rows in axes.items():
        # Two aggregates of one row each.
        one = scoring.auroc(rows, "y", "score").join(F.broadcast(scoring.average_precision(rows, "y", "score", "pair"))).withColumn("axis", F.lit(axis))
        out = one if out is None else out.unionByName(one)
    return out.select("axis", "auroc", "average_precision")


def axes(target: Graph, predicted: Graph) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and shd of the directed, skeleton and bidirected edges."""
    ends = lambda g: g.bidirected.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rows = [
        scoring.edge_sets(target.directed, predicted.directed, ["src", "dst"]).withColumn("axis", F.lit("directed")),
        scoring.edge_sets(skeleton(target), skeleton(predicted), ["a", "b"]).withColumn("axis", F.lit("skeleton")),
        scoring.edge_sets(ends(target), ends(predicted), ["a", "b"]).withColumn("axis", F.lit("bidirected")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def mixed_shd(pairs: DataFrame, target: Graph, predicted: Graph) -> int:
    """Unordered pairs of the universe whose edge state differs."""
    un = unordered(pairs)
    state = lambda g: scoring.mixed_states(g.directed.select("src", "dst"), g.bidirected.select("a", "b"))
    return scoring.mixed_distance(state(target).join(un, ["a", "b"], "left_semi"), state(predicted)).first()[0]


def validity(hidden_groups: list[str] | None, target_acyclic: bool, predicted_acyclic: bool) -> dict:
    """Whether distances between interventions apply, or why not: they are defined between acyclic graphs of observed variables."""
    if hidden_groups is None or hidden_groups:
        reason = f"the target hides {hidden_groups or 'groups it does not name'}, which project to bidirected edges; distances between interventions need an acyclic graph of observed variables"
    elif not target_acyclic:
        reason = "the directed target is cyclic at this floor"
    elif not predicted_acyclic:
        reason = "the predicted directed graph is cyclic"
    else:
        reason = "no library for these distances is installed"
    return {"value": None, "reason": reason}


def score(target: Graph, predicted: Graph, pairs: DataFrame, floor: float = DEFAULT_FLOOR, hidden_groups: list[str] | None = None) -> dict:
    """All axes at a floor. Results are a few numbers each; the edge sets stay DataFrames."""
    t, p = at_floor(target, floor), inside(predicted, pairs)
    acyclic = graphs.is_acyclic(t.directed, "src", "dst")
    compelled = graphs.compelled(t.directed) if acyclic else None
    k = t.directed.select("src", "dst").distinct().count()
    ranked = scored_universe(pairs, t.directed, p.directed, ["src", "dst"]).filter("score <> 0 OR y")
    top = scoring.top_k_distance(ranked, "y", "score", "pair").first() if k else None
    rows = {r.axis: {c: r[c] for c in ("tp", "fp", "fn", "precision", "recall", "f1", "shd")} for r in axes(t, p).collect()}  # three rows
    return {
        "floor": floor, "universe": {"ordered_pairs": pairs.count(), "unordered_pairs": unordered(pairs).count(), "predictions_outside": outside_count(predicted, pairs)},
        **rows, "orientation": {**orientation(t, p, compelled).first().asDict(), "truth_acyclic": acyclic}, "shd_mixed": mixed_shd(pairs, t, p),
        "ranks": {r.axis: {"auroc": r.auroc, "average_precision": r.average_precision} for r in ranks(pairs, t, p).collect()},
        "baselines": {"shd_empty_directed": k, "shd_empty_skeleton": skeleton(t).count(), "shd_empty_bidirected": t.bidirected.count(), "shd_topk_directed": top.shd if top else 0},
        "causal_validity": validity(hidden_groups, acyclic, graphs.is_acyclic(p.directed, "src", "dst")),
    }


def self_check(target: Graph, pairs: DataFrame, floor: float = DEFAULT_FLOOR) -> list[str]:
    """What is not perfect when the target is predicted: nothing, or the scorer is wrong."""
    found = score(target, as_prediction(target, floor), pairs, floor)
    problems = [f"{axis}: {found[axis]}" for axis in ("directed", "skeleton", "bidirected") if found[axis]["tp"] + found[axis]["fn"] and (found[axis]["f1"] != 1 or found[axis]["shd"])]
    if found["orientation"]["n"] and found["orientation"]["accuracy"] != 1:
        problems.append(f"orientation: {found['orientation']}")
    problems += [f"{axis}: {r}" for axis, r in found["ranks"].items() if r["auroc"] is not None and r["auroc"] < 1 - 1e-12]
    return problems + ([f"mixed: {found['shd_mixed']}"] if found["shd_mixed"] else [])


def headline(results: DataFrame, metric: str, least_seeds: int = 5) -> DataFrame:
    """Mean, spread and deciles of a metric over seeds; fewer than ``least_seeds`` are refused."""
    if results.limit(least_seeds).count() < least_seeds:
        raise ValueError(f"a headline needs at least {least_seeds} seeds")
    from hopwright.operators import series

    return series.headline(results.select(F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value")), "metric", "value")
