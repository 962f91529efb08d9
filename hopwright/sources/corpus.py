"""The corpus directory: raw feed, views, sample tables, allow-list, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
#: The union of the fields of all record kinds; what a kind lacks is null.
FEED = T.StructType(
    [
        T.StructField(n, k)
        for n, k in (
            *((n, _S) for n in "kind ts log_id pod service host method path".split()), ("status", _S), ("request_time", _D), ("upstream_response_time", _S),
            *((n, _S) for n in "request_id trace_id client_ip user_agent".split()), ("body_bytes", _I), ("part", _I), ("total_parts", _I),
            *((n, _S) for n in "level log_source message event_id title page_url sentry_trace_id error_module error_code http_failed".split()),
            ("breadcrumbs", T.ArrayType(T.StructType([T.StructField("ts", _S), T.StructField("method", _S), T.StructField("status", _I), T.StructField("url", _S)]))),
            *((n, _S) for n in "device_id account_id op description".split()), ("duration_ms", _L),
        )
    ]
)
#: What a method under test may read.
READABLE = ("raw/", "views/", "metrics/")
RECORDS_PER_FILE = 50_000


def read_feed(spark: SparkSession, corpus: str, shards: list[str] | None = None) -> DataFrame:
    """The records of a corpus's raw files (never its state files), of the given shards or of all."""
    names = "{" + ",".join(shards) + "}" if shards else "*"
    reader = spark.read.schema(FEED).option("basePath", f"{corpus}/raw")
    # Files whose names begin with '.' or '_' are none of the feed's; the state file is told by its whole name.
    rows = reader.option("pathGlobFilter", "*.json*").json(f"{corpus}/raw/shard={names}")
    return rows.filter(~F.input_file_name().rlike(r"/state\.jsonl?(\.gz)?$"))


def write_feed(records: DataFrame, corpus: str, replace: bool = False) -> None:
    """Records as gzipped JSON lines by shard, in order of time and id within each file, files of a bounded number of rows; one commit
    for all. ``replace`` renews the shards that ``records`` has and leaves the others."""
    ordered = records.repartitionByRange("shard", "ts", "log_id").sortWithinPartitions("shard", "ts", "log_id")
    out = ordered.write.mode("overwrite" if replace else "append").option("partitionOverwriteMode", "dynamic")
    out.option("compression", "gzip").option("maxRecordsPerFile", 20 * RECORDS_PER_FILE).partitionBy("shard").json(f"{corpus}/raw")


def completed_shards(spark: SparkSession, corpus: str) -> list[str]:
    """Shards that have a marker file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.done").option("recursiveFileLookup", "true").load(f"{corpus}/raw").select("path")
    return sorted(r[0] for r in found.select(F.regexp_extract("path", r"shard=([^/.]+)", 1)).distinct().collect())


def evenly_spaced(items: list, most: int = 12) -> list:
    """At most ``most`` items at even distances, the first and the last among them."""
    if len(items) <= most:
        return list(items)
    return [items[i] for i in sorted({round(k * (len(items) - 1) / (most - 1)) for k in range(most)})]


def is_readable(path: Column) -> Column:
    """Whether a path within the corpus is open to a method; one that climbs out of it is not."""
    return path.rlike("^(" + "|".join(READABLE) + ")") & ~path.rlike(r"(^|/)\.\.(/|$)")


def write_views(rows: DataFrame, path: str) -> None:
    """View rows by split and date, files of a bounded number of rows. Ranges of split, date and a hash of the row are dealt out, so
    that a date of any size is spread over tasks and each task writes few dates."""
    ranged = rows.repartitionByRange("split", "date", F.xxhash64(*rows.columns))
    ranged.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", RECORDS_PER_FILE).partitionBy("split", "date").parquet(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """Sequence labels; without any, a table that still has its columns."""
    labels.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_samples(spark: SparkSession, corpus: str) -> DataFrame:
    return spark.read.parquet(f"{corpus}/metrics/samples")


def read_changes(spark: SparkSession, corpus: str) -> DataFrame:
    return spark.read.parquet(f"{corpus}/oracle/state")


def read_catalogue(spark: SparkSession, corpus: str) -> DataFrame:
    return spark.read.json(f"{corpus}/metrics/series")


def open_for_method(spark: SparkSession, corpus: str, path: str) -> DataFrame:
    """A table that a method under test may read; any other path is refused."""
    if not any(path.startswith(p) for p in READABLE) or ".." in path.split("/"):
        raise PermissionError(f"{path} is not open to methods")
    return spark.read.parquet(f"{corpus}/{path}")


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def manifest(spark: SparkSession, corpus: str) -> DataFrame:
    """path, bytes, sha256 and readable of every file of a corpus."""
    root = corpus.rstrip("/").removeprefix("file://")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(corpus).select("path", "length")
    kind = "path string, length bigint, sha256 string"
    hashed = files.repartition(max(1, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(_digests, kind)
    return hashed.select(F.substring_index("path", f"{root}/", -1).alias("path"), F.col("length").alias("bytes"), "sha256").withColumn("readable", is_readable(F.col("path")))


def _digests(batches):
    """SHA-256 of files, a megabyte at a time: a file of any size fits."""
    import hashlib
    from urllib.parse import quote

    from pyarrow import fs

    for batch in batches:
        found = []
        for path in batch["path"]:
            system, at = fs.FileSystem.from_uri(quote(path if "://" in path else "file://" + path.removeprefix("file:"), safe="/:"))
            digest = hashlib.sha256()
            with system.open_input_stream(at, compression=None) as stream:
                while chunk := stream.read(1 << 20):
                    digest.update(chunk)
            found.append(digest.hexdigest())
        yield batch.assign(sha256=found)


def manifest_problems(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): missing, changed or unlisted files."""
    a, b = listed.select("path", F.col("sha256").alias("was")), found.select("path", F.col("sha256").alias("is"))
    problem = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "unlisted").when(F.col("is") != F.col("was"), "changed")
    return a.join(b, "path", "full_outer").select("path", problem.alias("problem")).filter("problem is not null")


def content_hash(rows: DataFrame) -> DataFrame:
    """A hash of the rows that doesn't depend on their order; repeats count."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns))))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))
