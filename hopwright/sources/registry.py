"""A corpus as a whole: shard markers, run records, verification, frozen checksums, and plans for publishing.

Plans are DataFrames or lists that say what would be done; nothing here touches a network.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwright import topology
from hopwright.functions.ids import canonical_hash
from hopwright.sources import corpus as C

#: Files of a corpus folder that are not part of the corpus.
UNLISTED = ("manifest.json", "COMPLETE", "artifacts.json")
RUN_FOLDER = "run/"
NAMED = ("service", "pod", "host", "path")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all: written beside its place and moved."""
    fs, at = _fs(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(part, at)


def write_json(spark: SparkSession, path: str, value) -> None:
    """JSON with sorted keys; numbers that are none are refused."""
    write_text(spark, path, json.dumps(value, sort_keys=True, indent=1, ensure_ascii=False, allow_nan=False) + "\n")


def write_shards(records: DataFrame, spans: DataFrame, sessions: DataFrame, corpus: str, state: DataFrame | None = None) -> DataFrame:
    """Feed and oracle tables of the shards in ``records``, then a marker for each of them: (shard, records). A shard without a marker
    is not there, so a run that broke off is repeated whole; shards that are not written stay as they are."""
    spark = records.sparkSession
    by_shard = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard")
    C.write_feed(records, corpus, replace=True)
    for name, table in (("spans", spans), ("sessions", sessions)):
        by_shard(table).parquet(f"{corpus}/oracle/{name}")
    if state is not None:
        by_shard(state).parquet(f"{corpus}/oracle/state")
    counts = C.read_feed(spark, corpus).groupBy("shard").agg(F.count(F.lit(1)).alias("records"))
    for r in counts.collect():  # a row a shard
        write_json(spark, f"{corpus}/raw/shard={r.shard}.done", {"shard": r.shard, "records": r.records})
    return counts


def pending_shards(spark: SparkSession, corpus: str, wanted: list[int]) -> list[int]:
    """Shards that a run which goes on has still to make."""
    done = set(map(str, C.completed_shards(spark, corpus)))
    return [s for s in wanted if str(s) not in done]


def run_record(arguments: dict, results: dict, began: float, version: str) -> dict:
    """What a command was given, gave and took."""
    return {"arguments": arguments, "arguments_hash": canonical_hash(arguments), "results": results, "meta": {"seconds": round(time.time() - began, 3), "version": version}}


def event(log: Callable[[str], None], name: str, **fields) -> None:
    """A line of the event log."""
    log(json.dumps({"event": name, "at": round(time.time(), 3), **fields}, sort_keys=True, default=str))


def run_steps(steps: list[tuple[str, Callable[[], dict]]]) -> list[dict]:
    """Steps in order up to the first that fails: name, status, seconds and what it gave or why it failed."""
    out = []
    for name, step in steps:
        began = time.time()
        try:
            out.append({"step": name, "status": "ok", **(step() or {}), "seconds": round(time.time() - began, 3)})
        except Exception as e:  # the log is the result, whatever went wrong
            out.append({"step": name, "status": "failed", "error": f"{type(e).__name__}: {e}", "seconds": round(time.time() - began, 3)})
            break
    return out + [{"step": name, "status": "not run"} for name, _ in steps[len(out) :]]


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def listed(manifest: DataFrame) -> DataFrame:
    """The rows of a manifest that count: not the manifest itself, nor records of runs."""
    return manifest.filter(~F.col("path").isin(*UNLISTED) & ~F.col("path").startswith(RUN_FOLDER))


def outside_grammar(rows: DataFrame, column: str, kind: str | None = None) -> DataFrame:
    """(column, value) of names that the public grammar doesn't allow; null is no name."""
    bad = F.col(column).isNotNull() & ~F.col(column).rlike(f"^(?:{topology.GRAMMAR[kind or column]})$")
    return rows.filter(bad).select(F.lit(column).alias("column"), F.col(column).alias("value")).distinct()


def _escaped(word: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in word)


def trie_pattern(words: list[str]) -> str:
    """One expression for many literal words: common beginnings are tested once."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def of(node: dict) -> str:
        if not (ways := [_escaped(c) + of(n) for c, n in sorted(node.items()) if c]):
            return ""
        return ("(?:" + "|".join(ways) + ")" if len(ways) > 1 or "" in node else ways[0]) + ("?" if "" in node else "")

    return of(tree)


def denied_name(text: Column, words: list[str]) -> Column:
    """The first denied name in a text, letter case aside; null without one."""
    names = sorted({w.lower() for w in words if w})
    return F.nullif(F.regexp_extract(F.lower(text), f"({trie_pattern(names)})", 1), F.lit("")) if names else F.lit(None).cast("string")


def name_problems(rows: DataFrame, deny: list[str] = (), columns: tuple[str, ...] = NAMED) -> DataFrame:
    """(problem, column, value): names outside the grammar and denied names in any string column."""
    out = None
    for c in columns:
        if c in rows.columns:
            part = outside_grammar(rows, c).select(F.lit("outside the grammar").alias("problem"), "column", "value")
            out = part if out is None else out.unionByName(part)
    strings = [n for n, t in rows.dtypes if t == "string"]
    if deny and strings:
        fields = F.array(*(F.struct(F.lit(c).alias("column"), denied_name(F.col(c), list(deny)).alias("value")) for c in strings))
        found = rows.select(F.inline(fields)).filter("value is not null").distinct()
        part = found.select(F.lit("denied name").alias("problem"), "column", "value")
        out = part if out is None else out.unionByName(part)
    return out


def verify(spark: SparkSession, corpus: str, manifest: DataFrame, deny: list[str] = (), most: int = 200) -> DataFrame:
    """(problem, column, value) of a corpus: files against its manifest, names against the grammar and the deny list. A report of at most
    ``most`` rows."""
    files = C.manifest_problems(listed(manifest), listed(C.manifest(spark, corpus))).select("problem", F.lit("path").alias("column"), F.col("path").alias("value"))
    return files.unionByName(name_problems(C.read_feed(spark, corpus), deny)).orderBy("problem", "column", "value").limit(most)


def corpus_key(instance: str, variant: str, seed: int) -> str:
    return f"{instance}/{variant}/seed={seed}"


def freeze(corpora: DataFrame, files: DataFrame) -> DataFrame:
    """(corpus, path, sha256) of corpora of one version. ``corpora``: corpus, tool_version, constants_version; more than one version is
    refused."""
    versions = corpora.select("tool_version", "constants_version").distinct().limit(2).collect()
    if len(versions) != 1:
        raise ValueError(f"corpora must be of one version: {versions}")
    return files.join(corpora.select("corpus"), "corpus", "left_semi").select("corpus", "path", "sha256")


def derivable(complete: bool, variant: str, source_variant: str, version: tuple[int, ...], least: tuple[int, ...], problems: list[str]) -> list[str]:
    """Why a corpus can't be the source of a derived variant; nothing if it can."""
    checks = [
        (not complete, "the source is not complete"), (variant != source_variant, f"the source must be {source_variant}, is {variant}"),
        (version < least, f"the source was made by {'.'.join(map(str, version))}, {'.'.join(map(str, least))} is needed"), (bool(problems), f"the source doesn't verify: {problems[:3]}"),
    ]
    return [why for bad, why in checks if bad]


def upload_plan(files: DataFrame, prefix: str) -> DataFrame:
    """(path, target, bytes, sha256): where each file goes; two files with one target are refused."""
    plan = files.withColumn("target", F.concat(F.lit(prefix.rstrip("/") + "/"), "path")).select("path", "target", "bytes", "sha256")
    if twice := plan.groupBy("target").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(5).collect():
        raise ValueError(f"more than one file for {[r.target for r in twice]}")
    return plan


def release_problems(plan: DataFrame, remote: DataFrame) -> DataFrame:
    """(target, problem): what a store (target, bytes, sha256) lacks or holds otherwise."""
    there = remote.select("target", F.col("bytes").alias("b2"), F.col("sha256").alias("s2"))
    why = F.when(F.col("b2").isNull(), "missing").when(F.col("b2") != F.col("bytes"), "size").when(F.col("s2").isNotNull() & (F.col("s2") != F.col("sha256")), "checksum")
    return plan.join(there, "target", "left").select("target", why.alias("problem")).filter("problem is not null")


def inventory_status(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(path, status) of files here and in a store: same, differs, only here, only there."""
    a, b = local.select("path", F.col("sha256").alias("x")), remote.select("path", F.col("sha256").alias("y"))
    status = F.when(F.col("y").isNull(), "only here").when(F.col("x").isNull(), "only there").when(F.col("x") == F.col("y"), "same").otherwise("differs")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def library_version_problem(name: str, recorded: str) -> str | None:
    """Random streams hold only within a minor version of their library."""
    import importlib

    have = ".".join(importlib.import_module(name).__version__.split(".")[:2])
    return None if have == recorded else f"{name} {have} differs from the corpus's {recorded}"


def instantiation(config: dict, system: topology.System, seed: int, constants_version: str) -> dict:
    """What identifies an instance: the configuration's hash, the seed and the counts."""
    from dataclasses import asdict

    drawn = {"services": [asdict(s) for s in system.services], "ops": [asdict(o) for o in system.ops], "calls": [asdict(c) for c in system.calls], "scenarios": [asdict(s) for s in system.scenarios]}
    return {
        "instance": config["name"], "seed": seed, "config_hash": canonical_hash(config), "topology_hash": canonical_hash(drawn), "constants_version": constants_version,
        "counts": {k: len(v) for k, v in drawn.items()}, "topology": drawn,
    }


def same_instance(recorded: dict, made: dict) -> list[str]:
    """What differs between a recorded instantiation and one made again."""
    return [f"{k}: {recorded.get(k)!r} was recorded, {made.get(k)!r} is made" for k in ("config_hash", "topology_hash", "constants_version", "seed") if recorded.get(k) != made.get(k)]


def within_cap(expected_gb: float, cap_gb: float) -> None:
    """Refuses what would be larger than allowed, before anything is made."""
    if expected_gb > cap_gb:
        raise ValueError(f"about {expected_gb:.1f} GB are expected, {cap_gb:g} GB are allowed")


def link_or_copy(source: str, target: str) -> str:
    """A second name for a local file where the file system has them, else a copy."""
    import shutil

    os.makedirs(os.path.dirname(target), exist_ok=True)
    try:
        os.link(source, target)
        return "linked"
    except OSError:
        shutil.copy2(source, target)
        return "copied"
