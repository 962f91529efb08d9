"""Raw records to spans: merging split lines, harvesting keys, the span table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopwright.functions import spans as S

APP_KINDS = ("vl.app", "vl.audit")


def merge_parts(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """One row per key: the text of its parts joined in order, how many there were, and the other fields of the first part."""
    others = [c for c in lines.columns if c not in (key, order, text)]
    first = [F.min_by(F.col(c), F.col(order)).alias(c) for c in others]
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))), lambda p: F.coalesce(p[text], F.lit(""))), "")
    return lines.groupBy(key).agg(whole.alias(text), F.count(F.lit(1)).alias("parts_seen"), *first)


def merge_split_lines(records: DataFrame) -> DataFrame:
    """Split application lines merged by log_id, all other records as they are."""
    split = F.col("kind").isin(*APP_KINDS) & (F.coalesce("total_parts", F.lit(1)) > 1)
    parts = merge_parts(records.filter(split), "log_id", "part", "message")
    rest = records.filter(~F.coalesce(split, F.lit(False))).withColumn("parts_seen", F.lit(1).cast("bigint"))
    return rest.unionByName(parts, allowMissingColumns=True)


def normalise(records: DataFrame) -> DataFrame:
    """Spans with one keys and one http struct for all kinds; other kinds are dropped. A session id that only repeats the cart id is refused."""
    r = merge_split_lines(records)
    kind, app = F.col("kind"), F.col("kind").isin(*APP_KINDS)
    found = {k: S.text_key(F.col("message"), k) for k in S.TEXT_KEYS}
    access, error, txn = kind == "vl.access", kind == "sentry.error", kind == "sentry.transaction"
    own = lambda c: F.when(access | error, F.col(c))
    session = F.when(app, found["session_id"])
    cart = F.when(app, found["cart_id"])
    refused = F.coalesce(session == cart, F.lit(False))
    keys = F.struct(
        F.when(app, found["request_id"]).otherwise(own("request_id")).alias("request_id"),
        F.when(app, found["trace_id"]).otherwise(F.when(access, F.col("trace_id"))).alias("trace_id"),
        F.when(app, found["correlation_id"]).alias("correlation_id"),
        F.when(~refused, session).alias("session_id"),
        cart.alias("cart_id"),
        F.when(app, found["client_unique_header"]).otherwise(F.when(error | txn, F.col("device_id"))).alias("device_id"),
        F.when(app, found["sub"]).otherwise(F.when(error, F.nullif(F.col("account_id"), F.lit("empty")))).alias("account"),
        F.when(error | txn, F.col("sentry_trace_id")).alias("sentry_trace_id"),
        F.when(access, F.col("client_ip")).alias("client_ip"),
        refused.alias("session_id_is_cart_fallback"),
    )
    http = F.struct(
        F.when(access, F.col("method")).alias("method"),
        F.when(access, F.col("path")).when(app, F.coalesce(found["url"], found["external_url"])).otherwise(F.col("page_url")).alias("path"),
        F.when(app, S.text_number(F.col("message"), "response_status")).when(error, F.lit(None)).otherwise(F.col("status").cast("bigint")).alias("status"),
        F.when(access, F.col("request_time")).when(txn, F.coalesce(F.col("duration_ms"), F.lit(0)) / 1000.0).alias("request_time"),
    )
    return r.filter(app | access | error | txn).select(
        F.col("log_id").alias("span_id"), "kind", S.epoch_ms(F.to_timestamp("ts")).alias("ts_ms"), "service", "pod", "log_source", keys.alias("keys"), http.alias("http")
    )


def last_by(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Last value per key, as a later record overwrites an earlier one."""
    return df.groupBy(key).agg(F.max_by(F.col(value), F.struct(*order)).alias(value))


def breadcrumbs(events: DataFrame, key: str, order: str, crumb: str, before: int = 50) -> DataFrame:
    """Each row with the crumbs of up to ``before`` rows before it, then its own."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-before, 0)
    return events.withColumn("crumbs", F.collect_list(crumb).over(w))
