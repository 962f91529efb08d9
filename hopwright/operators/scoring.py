"""Scores of predictions against truth: confusion, ranks, structural distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwright.storage import Rounds


def confusion(truth: Column, predicted: Column) -> list[Column]:
    n = lambda c, name: F.count_if(c).alias(name)
    return [n(truth & predicted, "tp"), n(~truth & predicted, "fp"), n(truth & ~predicted, "fn"), n(~truth & ~predicted, "tn")]


def prf(df: DataFrame, empty: float | None = None) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn; a zero denominator gives ``empty`` (null in reports, 0 in scores)."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(empty).cast("double"))
    df = df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", ratio(2 * p * r, p + r))


def auroc(scored: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve with mean ranks for ties; null without both classes.

    Rows are first counted by score, so ties of any size are one row, and ranks come from running sums over score ranges: no
    task holds all rows.
    """
    by = scored.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth)).alias("pos"))
    by = running(by, [F.asc("s")], {"n": "below"})
    ranks = by.agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2.0)).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    return ranks.select(F.try_divide(F.col("r") - p * (p + 1) / 2, p * q).alias("auroc"))


def running(df: DataFrame, order: list[Column], sums: dict[str, str], parts: int = 64) -> DataFrame:
    """For each column of ``sums`` the total over the rows before, in ``order``, under the name it gives.

    Rows are dealt by ranges of the order; a range is summed on its own and shifted by the totals of the ranges before it, so no
    task holds all rows. The dealt rows are written, so both passes see the same ranges.
    """
    ranged = Rounds(df.sparkSession, "ranges").settle(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part").agg(*(F.sum(v).alias(f"__{v}") for v in sums))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *(F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)).alias(f"__start_{v}") for v in sums))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # A row for each of the parts.
    out = ranged.join(F.broadcast(starts), "__part")
    return out.withColumns({name: F.col(f"__start_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0)) for v, name in sums.items()}).drop("__part", *(f"__start_{v}" for v in sums))


def average_precision(scored: DataFrame, truth: str, score: str, position: str) -> DataFrame:
    """Mean precision at the positives in descending order of score, ties in order of position; null without positives."""
    rows = scored.select(F.col(truth).cast("int").alias("y"), F.lit(1).alias("one"), F.col(score).alias("s"), F.col(position).alias("at"))
    ranked = running(rows, [F.desc("s"), F.asc("at")], {"y": "hits", "one": "before"})
    return ranked.agg(F.try_divide(F.sum((F.col("hits") + F.col("y")) / (F.col("before") + 1) * F.col("y")), F.sum("y").cast("double")).alias("average_precision"))


def top_k_distance(scored: DataFrame, truth: str, score: str, position: str) -> DataFrame:
    """Symmetric difference of the truth and as many top predictions, ties in order of position. Ranks come from ranges of the order."""
    rows = scored.select(F.col(truth).cast("int").alias("y"), F.lit(1).alias("one"), F.col(score).alias("s"), F.col(position).alias("at"))
    k = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("k"))
    top = running(rows, [F.desc("s"), F.asc("at")], {"one": "before"}).join(F.broadcast(k)).filter(F.col("before") < F.col("k"))
    hits = top.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("n"))
    return hits.join(F.broadcast(k)).select("k", "hits", (F.col("n") + F.col("k") - 2 * F.col("hits")).alias("shd"))


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()


def keep_last(predictions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Predictions with repeats overwritten by the later one; a score that is missing is 1."""
    return predictions.groupBy(*keys).agg(F.max_by(F.coalesce(F.col("score"), F.lit(1.0)), F.col(order)).alias("score"))


def edge_sets(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn of two edge sets with precision, recall, f1 and shd."""
    t = truth.select(*keys).distinct().withColumn("t", F.lit(True))
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(True))
    both = t.join(p, keys, "full_outer").select(F.coalesce("t", F.lit(False)).alias("t"), F.coalesce("p", F.lit(False)).alias("p"))
    return prf(both.agg(*confusion(F.col("t"), F.col("p"))).drop("tn"), 0.0).withColumn("shd", F.col("fp") + F.col("fn"))


def mixed_states(directed: DataFrame, bidirected: DataFrame) -> DataFrame:
    """State of every unordered pair: 1 a to b, 2 b to a, 4 both ways confounded; bits are added."""
    d = directed.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when(F.col("src") < F.col("dst"), 1).otherwise(2).alias("bit"))
    b = bidirected.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(4).alias("bit"))
    return d.unionByName(b).groupBy("a", "b").agg(F.bit_or("bit").alias("state"))


def mixed_distance(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pairs whose states differ."""
    t, p = truth.withColumnRenamed("state", "t"), predicted.withColumnRenamed("state", "p")
    return t.join(p, ["a", "b"], "full_outer").agg(F.count_if(~F.col("t").eqNullSafe(F.col("p"))).alias("shd"))


def total_variation(p: DataFrame, q: DataFrame, key: str, share: str) -> DataFrame:
    a, b = p.select(key, F.col(share).alias("p")), q.select(key, F.col(share).alias("q"))
    return a.join(b, key, "full_outer").agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("tv"))


def most_variation(rows: DataFrame, group: str, shares: str) -> DataFrame:
    """The greatest total variation between two distributions of a group: the strength of an edge, where a row holds the child's shares
    under one value of its parent. A group has as many rows as the parent has values."""
    each = rows.groupBy(group).agg(F.collect_list(shares).alias("__rows"))
    apart = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 2
    return each.select(group, F.array_max(F.flatten(F.transform("__rows", lambda p: F.transform("__rows", lambda q: apart(p, q))))).alias("strength"))


def contrasts(rows: DataFrame, group: str, value: str, shares: str) -> DataFrame:
    """For each value of a source and each place in the end's distribution, how far setting that value moves it from the mean of the
    others: group, value, place, moved."""
    each = rows.select(group, value, F.posexplode(shares).alias("place", "p"))
    w = Window.partitionBy(group, "place")
    rest = F.try_divide(F.sum("p").over(w) - F.col("p"), (F.count(F.lit(1)).over(w) - 1).cast("double"))
    return each.select(group, value, "place", F.abs(F.col("p") - F.coalesce(rest, F.lit(0.0))).alias("moved"))
