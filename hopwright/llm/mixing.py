"""Mixing sources to target weights by Poisson replication.

A source with n documents and a target weight w gets the mean repetition rate w * total / n. A document's number of copies is
a Poisson draw with that mean, got by inverting the distribution at a uniform number hashed from seed and key; a mean above
``CHUNK`` is split into equal parts, each with a draw of its own, as the sum of Poisson draws is Poisson. Copies are exploded
and put into a global order by a hash of seed, key and copy.

Rates are aggregated from all rows (one number a source). Up to ``MAX_SOURCES`` sources they are broadcast; beyond that rows
join them by salted source, so that a source with a third of all rows is spread out. A null source is a source; null keys draw
like one key; repeated keys draw alike. Texts aren't read: null, empty and very long ones are documents like others. Rows of equal
order (repeated keys) stand beside each other in any order. An empty table gives no rows. Other columns are carried along; those of
``mix`` begin with '__' and replace such columns of the input. ``replicas`` gives the input's columns alone, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwright.llm.common import boxed, table

SEED = 20
CHUNK = 8.0
#: Terms of the distribution; beyond them less than 1e-30 is left at a mean of CHUNK.
TERMS = 64
MAX_SOURCES = 50_000
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A uniform number in (0, 1) of 48 bits from an MD5 of the parts."""
    text = F.concat_ws("|", *parts)
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS - 1 as an array."""
    terms = F.array(*(F.exp(-mean) * F.pow(mean, F.lit(float(k))) / float(math.factorial(k)) for k in range(TERMS)))
    start = F.array().cast("array<double>")
    return F.aggregate(terms, start, lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x)))


def rates(docs: DataFrame, source: str = "source", weights: dict | None = None, temperature: float = 0.5, total: int | None = None) -> DataFrame:
    """``__source``, its rate, the parts it is split into and the distribution of one part.

    ``weights`` names relative target weights by source (others get none); without them a source weighs its documents to the
    power of ``temperature``. ``total`` is the mean number of rows to give out, by default as many as there are.
    """
    n = docs.groupBy(F.col(source).alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        weight = F.pow(F.col("__n").cast("double"), F.lit(temperature))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("__source")), F.lit(0.0)) if pairs else F.lit(0.0)
    n = n.withColumn("__weight", weight)
    sums = n.agg(F.sum("__weight").alias("__weights"), F.sum("__n").alias("__all"))
    goal = F.col("__all") if total is None else F.lit(total)
    n = n.crossJoin(F.broadcast(sums)).withColumn("__rate", F.coalesce(F.try_divide(F.col("__weight") * goal, F.col("__weights") * F.col("__n")), F.lit(0.0)))
    n = n.withColumn("__parts", F.greatest(F.lit(1), F.ceil(F.col("__rate") / CHUNK).cast("int")))
    return n.select("__source", "__rate", "__parts", poisson_cdf(F.col("__rate") / F.col("__parts")).alias("__cdf"))


def replicate(docs: DataFrame, table_of_rates: DataFrame, key: str = "doc_id", source: str = "source", seed: int = SEED, few: bool = True) -> DataFrame:
    """``docs`` with ``__rate``, ``__copies``, ``__copy`` (from 1) and ``__order``, in global order of the last."""
    named = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rows = docs.withColumns({"__key": named, "__s": F.col(source)})
    if few:
        rows = rows.join(F.broadcast(table_of_rates), F.col("__s").eqNullSafe(F.col("__source")))
    else:
        salted = table_of_rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__own", F.pmod(F.xxhash64("__key"), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, F.col("__s").eqNullSafe(F.col("__source")) & (F.col("__own") == F.col("__salt"))).drop("__own", "__salt")
    draw = lambda j: uniform(F.lit(str(seed)), F.col("__key"), j.cast("string"))
    one = lambda u: F.size(F.filter("__cdf", lambda c: u >= c))
    copies = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda j: draw(j)), F.lit(0), lambda a, u: a + one(u))
    rows = rows.withColumn("__copies", copies).filter("__copies > 0").drop("__cdf", "__parts", "__source", "__s")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), "__key", F.col("__copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    return rows.withColumn("__order", order).drop("__key").orderBy("__order")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", seed: int = SEED, **how) -> DataFrame:
    """``docs`` replicated to the target weights; see ``rates`` for the choices and ``replicate`` for the columns."""
    few = docs.select(source).distinct().limit(MAX_SOURCES + 1).count() <= MAX_SOURCES
    return replicate(docs, rates(docs, source, **how), key, source, seed, few)


def replicas(docs: DataFrame, key: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The rows that ``mix`` gives, with the columns of ``docs`` alone, whatever their names."""
    return mix(boxed(docs, F.col(key).alias("key"), F.col(source).alias("source")), "key", "source", **how).select("__row.*")


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", F.round("__rate", 9).alias("rate"), F.col("__copies").alias("copies"), F.col("__copy").alias("copy"), F.col("__order").alias("shuffle_key"))


def op8_sql() -> str:
    terms = ", ".join(f"exp(-m) * pow(m, {float(k)!r}) / {float(math.factorial(k))!r}" for k in range(TERMS))
    return f"""
    WITH n AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
    r AS (SELECT source, w * (SELECT sum(n) FROM n)::DOUBLE / ((SELECT sum(w) FROM n) * n) AS rate FROM n),
    p AS (SELECT *, greatest(1, ceil(rate / {CHUNK})::INTEGER) AS parts FROM r),
    t AS (SELECT *, rate / parts AS m FROM p),
    c AS (SELECT source, rate, parts, [{terms}] AS terms FROM t),
    f AS (SELECT source, rate, parts, list_transform(range(1, {TERMS} + 1), lambda k: list_sum(terms[1:k])) AS cdf FROM c),
    u AS (SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, source FROM documents),
    j AS (SELECT row, doc_id, k, u.source, rate, cdf, unnest(range(1, parts + 1)) AS part FROM u JOIN f ON u.source IS NOT DISTINCT FROM f.source),
    d AS (SELECT *, (('0x' || substr(md5('{SEED}|' || k || '|' || part), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS v FROM j),
    s AS (SELECT row, doc_id, k, source, rate, sum(len(list_filter(cdf, lambda x: v >= x)))::INTEGER AS copies FROM d GROUP BY ALL),
    x AS (SELECT *, unnest(range(1, copies + 1))::INTEGER AS copy FROM s)
    SELECT doc_id, source, round(rate, 9) AS rate, copies, copy, ('0x' || substr(md5('{SEED}|order|' || k || '|' || copy), 1, 15))::BIGINT AS shuffle_key FROM x
    """
