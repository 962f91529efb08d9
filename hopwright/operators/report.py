"""What a correlation lost, measured against the oracle's linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwright.operators import scoring

#: Names of attribution levels by code.
LEVEL_NAMES = ("session", "device", "user", "ip", "none")


def link_confusion(oracle: DataFrame, inferred: DataFrame) -> DataFrame:
    """Parent links per kind of hop and over all, with precision, recall and f1 (null on an empty denominator).

    ``oracle``: span_id, parent, is_edge; ``inferred``: span_id, parent. A wrong parent is both a false positive and a false negative.
    """
    found = inferred.select("span_id", F.col("parent").alias("guess"))
    both = oracle.join(found, "span_id", "left").select(F.when(F.col("is_edge"), "edge").otherwise("internal").alias("kind"), F.col("parent").alias("t"), F.col("guess").alias("p"))
    return link_confusion_of(both)


def link_confusion_of(both: DataFrame) -> DataFrame:
    """``link_confusion`` of rows that have both parents: kind, t (true) and p (inferred)."""
    t, p = F.col("t"), F.col("p")
    wrong = t.isNotNull() & p.isNotNull() & (t != p)
    counts = [
        F.count_if(t == p).alias("tp"), F.count_if(t.isNull() & p.isNotNull() | wrong).alias("fp"), F.count_if(t.isNotNull() & p.isNull() | wrong).alias("fn"), F.count_if(t.isNull() & p.isNull()).alias("tn"),
    ]
    per = both.rollup("kind").agg(*counts).withColumn("kind", F.coalesce("kind", F.lit("all")))
    return scoring.prf(per)


def level_histogram(attribution: DataFrame, level: str = "level") -> DataFrame:
    """Rows per attribution level, by name."""
    names = F.array(*map(F.lit, LEVEL_NAMES))
    return attribution.groupBy(F.element_at(names, F.coalesce(F.col(level), F.lit(4)).cast("int") + 1).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def losses(records: DataFrame, attribution: DataFrame, links: DataFrame, hops: DataFrame) -> DataFrame:
    """One row: spans, the share without an identity, client errors, the share of them that is linked, and inner hops without a parent."""
    levels = attribution.select("span_id", "level")
    linked = links.select("span_id").distinct().withColumn("linked", F.lit(True))
    error = F.col("kind") == "sentry.error"
    spans = records.select("span_id", "kind").join(levels, "span_id", "left").join(linked, "span_id", "left").agg(
        F.count(F.lit(1)).alias("spans"), F.count_if(F.coalesce("level", F.lit(4)) == 4).alias("unattributed"), F.count_if(error).alias("client_errors"), F.count_if(error & F.coalesce("linked", F.lit(False))).alias("client_linked")
    )
    orphans = hops.agg(F.count_if(~F.col("is_edge") & F.col("parent").isNull()).alias("orphan_internal_hops"))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    # Two aggregates of one row.
    return spans.join(F.broadcast(orphans)).withColumns({"unattributed_fraction": share("unattributed", "spans"), "client_error_linked_fraction": share("client_linked", "client_errors")})


def feed_counts(records: DataFrame) -> DataFrame:
    """Spans, lines that were merged from parts, and session ids refused because they repeat the cart's."""
    return records.agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("keys.session_id_is_cart_fallback")).alias("cart_fallbacks"))


def recovery_summary(members: DataFrame, truth: str, found: str) -> DataFrame:
    """True sessions, their mean Jaccard index with the best sequence, the share that was split, and the share of merged sequences.

    A true session without any sequence counts with 0; ``members`` has a row per hop, ``found`` null where it is in no sequence.
    """
    from hopwright.operators import sequences

    sessions = members.filter(F.col(truth).isNotNull())
    n = sessions.groupBy(truth).agg(F.count(F.lit(1)).alias("n"))
    common = sessions.filter(F.col(found).isNotNull()).groupBy(truth, found).agg(F.count(F.lit(1)).alias("c"))
    size = sessions.filter(F.col(found).isNotNull()).groupBy(found).agg(F.count(F.lit(1)).alias("s"))
    best = common.join(size, found).groupBy(truth).agg(F.min(F.struct((-F.col("c")).alias("c"), F.col(found).alias("f"), F.col("s").alias("s"))).alias("b"), F.count(F.lit(1)).alias("pieces"))
    per = n.join(best, truth, "left").select((F.coalesce(-F.col("b.c") / (F.col("n") + F.col("b.s") + F.col("b.c")), F.lit(0.0))).alias("jaccard"), F.coalesce("pieces", F.lit(0)).alias("pieces"))
    one = per.agg(F.count(F.lit(1)).alias("true_sessions"), F.avg("jaccard").alias("mean_jaccard"), F.count_if(F.col("pieces") > 1).alias("split"))
    merged = sequences.merge_rate(members.filter(F.col(found).isNotNull()), truth, found)
    return one.withColumn("split_rate", F.col("split") / F.greatest("true_sessions", F.lit(1))).join(F.broadcast(merged))
