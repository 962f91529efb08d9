"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a session whose tasks run in the driver's own
    process, as in tests, gets a temporary one where it names none; any other is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = getattr(spark, "_hopwright_shared", None)
    if made is None:
        made = f"file://{tempfile.mkdtemp(prefix='hopwright-')}"
        spark._hopwright_shared = made
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(id(spark.sparkContext), []).append(path)
    return path


#: Every path handed out, by context.
_made: dict[int, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate data."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes a table of ``written`` that no later step reads."""
    if path := getattr(df, "stored_at", None):
        delete(df.sparkSession, path)


def release_shuffles(spark: SparkSession) -> None:
    """Lets the session's cleaner drop the shuffle files of steps whose results are written; it waits for the driver's collector."""
    gc.collect()
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this session; results that were not yet read are lost with them."""
    for path in _made.pop(id(spark.sparkContext), []):
        delete(spark, path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Only A-Z are lowered; lower() would change other letters as well."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes not to be a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """``df.filter(condition)`` that stays where it is. A filter on a long chain of computed columns would else be pushed below all
    of them, which writes each column's expression into the next and makes a predicate of exponential size."""
    here = unused(df, "__here")[0]
    marked = df.withColumn(here, F.spark_partition_id())
    return marked.filter(condition & (F.col(here) >= 0)).drop(here)


def boxed(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``df`` with each row as one struct, ``__row``, beside the given columns: what it is called inside can't clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), *columns)


#: Rows of a key that one share of it has at least; at most so many keys have more than one share.
SHARE_ROWS, MOST_SPLIT = 512, 20_000


def split_keys(totals: DataFrame, rows: int, share_rows: int = SHARE_ROWS) -> DataFrame:
    """(key, shares) of the keys whose rows are too many for one task, from ``totals`` (key, n) over ``rows`` rows. A share has at
    least rows / MOST_SPLIT rows, so these are MOST_SPLIT keys at most, whatever the input: few enough to broadcast."""
    share = max(share_rows, -(-rows // MOST_SPLIT))
    return totals.filter(F.col("n") > share).select("key", F.ceil(F.col("n") / share).cast("int").alias("shares"))


def shared_join(rows: DataFrame, by: Column, spread: Column, lists: DataFrame, split: DataFrame) -> DataFrame:
    """``rows`` left-joined to ``lists`` (key and what it holds, a row a key) on ``by``: a key of ``split`` is dealt over its shares by
    ``spread``, and its list is there once for each. Columns key and share go."""
    key, share, shares = unused(rows, "__by", "__share", "__shares")
    lists = lists.withColumnRenamed("key", "__list_key")
    split = split.withColumnRenamed("key", "__list_key")
    keyed = rows.withColumn(key, by).join(F.broadcast(split.select(F.col("__list_key").alias(key), F.col("shares").alias(shares))), key, "left")
    keyed = keyed.withColumn(share, F.pmod(F.xxhash64(spread), F.coalesce(shares, F.lit(1))).cast("int")).drop(shares)
    each = lists.join(F.broadcast(split), "__list_key", "left").withColumn("__list_share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    return keyed.join(each.withColumnsRenamed({"__list_key": key, "__list_share": share}), [key, share], "left").drop(key, share)
