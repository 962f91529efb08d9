"""Column expressions of the span model: outcomes, times, addresses, splits and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outcome codes and their severity.
OK, CLIENT_ERROR, SERVER_ERROR, ERROR, SLOW = 0, 1, 2, 3, 4
SEVERITY = {OK: 0, SLOW: 1, CLIENT_ERROR: 2, SERVER_ERROR: 3, ERROR: 4}
#: Keys that are harvested from free text.
TEXT_KEYS = ("request_id", "trace_id", "correlation_id", "session_id", "cart_id", "client_unique_header", "sub", "url", "external_url")


def outcome_of(status: Column, seconds: Column, threshold: Column) -> Column:
    """Class of a response: no status is an error, then 4xx, 5xx, slow beyond the threshold, ok."""
    return (
        F.when(status.isNull() | (status == 0), ERROR).when(status.between(400, 499), CLIENT_ERROR).when(status >= 500, SERVER_ERROR).when(seconds > threshold, SLOW).otherwise(OK)
    )


def severity(outcome: Column) -> Column:
    out = None
    for code, level in SEVERITY.items():
        out = F.when(outcome == code, level) if out is None else out.when(outcome == code, level)
    return out


def worst_outcome(outcome: Column) -> Column:
    """Aggregate: the most severe outcome."""
    return F.max_by(outcome, severity(outcome))


def epoch_ms(ts: Column) -> Column:
    """Whole milliseconds of a timestamp."""
    return F.unix_millis(ts.cast("timestamp"))


def start_ms(end_ms: Column, seconds: Column) -> Column:
    """The start of a span from its end and duration; the duration is truncated to milliseconds first."""
    return end_ms - (F.coalesce(seconds, F.lit(0.0)) * 1000).cast("bigint")


def day_of(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def is_internal(address: Column) -> Column:
    return F.coalesce(address, F.lit("")).startswith("10.")


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets


def split_of(key: Column) -> Column:
    """train, val or test (80, 10, 10) by a hash of the key."""
    b = hash_bucket(key)
    return F.when(b < 80, "train").when(b < 90, "val").otherwise("test")


def url_path(url: Column) -> Column:
    """The part of a URL from its path on; what has no '//' is a path already."""
    return F.when(url.contains("//"), F.concat(F.lit("/"), F.element_at(F.split(url, "/", 4), -1))).otherwise(url)


def endpoint_column(path: Column) -> Column:
    return F.translate(path, "/{}.", "____")


def text_key(message: Column, key: str) -> Column:
    """The first quoted value of a key in free text; empty counts as missing."""
    return F.nullif(F.regexp_extract(message, rf'"{key}":\s*"([^"]+)"', 1), F.lit(""))


def text_number(message: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(message, rf'"{key}":\s*(-?\d+)', 1), F.lit("")).cast("bigint")


def within_tolerance(a: Column, b: Column, absolute: float = 0.01, relative: float = 0.1) -> Column:
    """Whether a measurement is close to a constant; against a constant of zero only the absolute bound counts."""
    return F.abs(a - b) <= F.when(b == 0, absolute).otherwise(F.greatest(F.lit(absolute), relative * F.abs(b)))


def next_on_grid(value: Column, step: int) -> Column:
    """The first multiple of ``step`` at or after an integer."""
    return ((value + step - 1) - F.pmod(value + step - 1, F.lit(step))).cast("bigint")


#: The statuses that an outcome (ok, 4xx, 5xx, err, slow) is given, each of five as likely.
STATUSES = ((200, 200, 200, 201, 204), (400, 400, 404, 403, 409), (500, 500, 503, 502, 500), (0, 0, 0, 0, 0), (200, 200, 200, 201, 204))


def status_of(outcome: Column, u: Column) -> Column:
    """An HTTP status for an outcome, picked by a uniform number."""
    table = F.array(*(F.array(*map(F.lit, row)) for row in STATUSES))
    return F.get(F.get(table, outcome), F.floor(u * 5).cast("int"))


def within_repertoire(outcome: Column, allowed: list[int]) -> Column:
    """An outcome that an endpoint doesn't have becomes ok."""
    return F.when(outcome.isin(*allowed), outcome).otherwise(OK)


def client_error_chance(failed: Column, flaky: Column, on_failure: float = 0.98, on_flaky: float = 0.05) -> Column:
    """The chance that a client reports an error: the answer failed, or the network did."""
    return 1 - (1 - F.when(failed, on_failure).otherwise(0.0)) * (1 - F.when(flaky, on_flaky).otherwise(0.0))


def latency_multiplier(health: Column, pool: Column, cold: Column, degraded: float, tight: float, exhausted: float, miss: float) -> Column:
    """How much slower an operation's own time is in a state."""
    return F.when(health == 1, degraded).otherwise(1.0) * F.when(pool == 1, tight).when(pool == 2, exhausted).otherwise(1.0) * F.when(cold, miss).otherwise(1.0)


def iso_ms(ms: Column) -> Column:
    """Epoch milliseconds as ISO 8601 with milliseconds, in UTC."""
    return F.date_format(F.timestamp_millis(ms.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def profile(ms: Column, hours: list[float], days: list[float]) -> Column:
    """The multiplier of a rate by hour of the day and day of the week (Monday first)."""
    at = F.timestamp_millis(ms.cast("bigint"))
    pick = lambda values, i: F.element_at(F.array(*(F.lit(float(v)) for v in values)), i + 1)
    return pick(hours, F.hour(at)) * pick(days, F.weekday(at))
