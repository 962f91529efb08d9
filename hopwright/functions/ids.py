"""Stable identifiers and canonical hashes."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what ends each part of an identifier.
SEPARATOR = "\x1f"


def stable_hex(*parts, length: int = 32) -> str:
    """A hexadecimal digest (BLAKE2b) of the parts' texts, of the given length."""
    text = "".join(f"{p}{SEPARATOR}" for p in parts)
    return hashlib.blake2b(text.encode(), digest_size=(length + 1) // 2).hexdigest()[:length]


def stable_uuid(*parts) -> str:
    """The digest of 32 digits in the shape of a UUID."""
    h = stable_hex(*parts)
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def hex_id(length: int, *parts: Column) -> Column:
    """``stable_hex`` of columns. BLAKE2b is no function of the JVM: an Arrow function over the joined parts."""

    @F.pandas_udf("string")
    def digest(text: pd.Series) -> pd.Series:
        size = (length + 1) // 2
        return text.map(lambda t: hashlib.blake2b(t.encode(), digest_size=size).hexdigest()[:length])

    return digest(F.concat_ws(SEPARATOR, *(p.cast("string") for p in parts), F.lit("")))


def uuid_id(*parts: Column) -> Column:
    h = hex_id(32, *parts)
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def split_of(key: Column) -> Column:
    """train, val or test (80, 10, 10) by the digest of the key, as corpora that were split elsewhere have it."""
    bucket = F.conv(F.substring(hex_id(32, F.lit("split"), key), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(bucket < 80, "train").when(bucket < 90, "val").otherwise("test")


def canonical_json(value) -> str:
    """JSON with sorted keys and no blanks; numbers that are none are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_hash(value, length: int = 32) -> str:
    return hashlib.blake2b(canonical_json(value).encode(), digest_size=length // 2).hexdigest()
