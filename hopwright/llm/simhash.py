"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into 3 segments. Two fingerprints that differ in at most 4 bits have a segment in which
they differ in at most one bit: were it two in each, it would be six. Every segment is indexed once as it is and once per
bit with that bit replaced by a wildcard, and an equality join of those signatures gives every candidate; candidates are
verified on all 64 bits. A pair with an equal segment meets under each of that segment's signatures.

One index row stands for each distinct fingerprint, however many documents share it. Within a signature the fingerprints
are compared with vectors of 64-bit integers and only the edges of a spanning forest leave the task, so a large group of
near copies makes as many rows as it has members. A signature with more than ``HEAVY`` fingerprints is refined: there, the
remaining 43 bits are again cut into 3 segments with wildcards, which loses no pair, as a pair may differ in them by 4 bits
at most. What is still crowded is dealt into parts of about ``HEAVY`` and every two parts meet under a key of their own: all pairs
are compared, by as many tasks as it takes.

Null and empty texts have fingerprint zero, linked like any other. Texts are read whole, whatever their length. A bit that is set
in just half the hashes is 0. Repeated rows share a component; a null key takes part and gets the component of its text's group
(null if all its keys are null). An empty table gives an empty result; columns of the input beyond key and text are not read and
may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwright.llm.common import SHARE_ROWS, shared_join, split_keys, table, unused, written
from hopwright.llm.components import connected

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
HEAVY = 2048
_CHUNK = 1 << 15
_HELD = 1 << 19
#: Documents whose distinct fingerprints one task indexes.
_A_TASK = 20_000


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of word shingles, repeats included; A-Z are lowered, words are cut at ASCII white space."""
    raw = text.encode() if isinstance(text, str) else (text or b"")
    words = raw.lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, SEED)
    ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
    ends.append(len(line))
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
    ones, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, _CHUNK):
        h = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK], ends[at + shingle - 1 : at + _CHUNK + shingle - 1])), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint as a signed bigint) for each row."""
    source = docs.select(F.col(key), *keep, F.col(text).cast("binary").alias("__text"))
    schema = source.drop("__text").withColumn("fp", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(batch.num_columns - 1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return source.mapInArrow(run, schema)


def _signatures(fps: np.ndarray, segments, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, fingerprint) rows: for each segment the plain value and, per bit, the value without that bit."""
    fps = fps.view(np.uint64)
    keys = []
    for k, (first, bits) in enumerate(segments):
        part = (fps >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        head = np.uint64(k << 8)
        keys.append(_mix(part, head, base))
        for b in range(bits):
            keys.append(_mix(part & ~np.uint64(1 << b), head | np.uint64(b + 1), base))
    return np.concatenate(keys), np.tile(fps, len(keys))


def _mix(part: np.ndarray, head: np.uint64, base: np.ndarray | None) -> np.ndarray:
    """An exact key where nothing stands above it; else a 64-bit hash. A chance collision only adds a candidate to verify."""
    key = (part << np.uint64(16)) | head
    if base is None:
        return key
    x = base.view(np.uint64) ^ (key * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def spanning(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """The least index of each of n nodes' components under the edges a-b."""
    parent = np.arange(n) if parent is None else parent
    while True:
        pa_, pb = parent[a], parent[b]
        open_ = pa_ != pb
        if not open_.any():
            return parent
        a, b, pa_, pb = a[open_], b[open_], pa_[open_], pb[open_]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def links_in(keys: np.ndarray, fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning-forest edges between fingerprints that share a key and differ in at most ``max_bits`` bits; keys are sorted."""
    nodes, local = np.unique(fps, return_inverse=True)
    parent = np.arange(len(nodes))
    step, rows = 1, np.arange(len(keys))
    while True:
        rows = rows[rows + step < len(keys)]
        rows = rows[keys[rows] == keys[rows + step]]
        if not len(rows):
            break
        # Pairs that are joined already need no look.
        for at in range(0, len(rows), 1 << 20):
            i = rows[at : at + (1 << 20)]
            i = i[parent[local[i]] != parent[local[i + step]]]
            near = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= max_bits]
            if len(near):
                parent = spanning(len(nodes), local[near], local[near + step], parent)
        step += 1
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved].view(np.int64), nodes[parent[moved]].view(np.int64)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for at in range(0, len(fps), 1 << 14):
            k, f = _signatures(fps[at : at + (1 << 14)].copy(), SEGMENTS)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(f.view(np.int64))], names=["sig", "fp"])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, fp) of a heavy signature with the rest of the bits cut again."""
    for batch in batches:
        sig, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        which = ((sig.view(np.uint64) >> np.uint64(8)) & np.uint64(0xFF)).astype(int)
        for k in range(len(SEGMENTS)):
            rows = np.flatnonzero(which == k)
            others = [SEGMENTS[j] for j in range(len(SEGMENTS)) if j != k]
            width = sum(b for _, b in others)
            # The other two segments side by side, as one number of ``width`` bits.
            for at in range(0, len(rows), 1 << 14):
                part = rows[at : at + (1 << 14)]
                f = fps[part].view(np.uint64)
                low = (f >> np.uint64(others[0][0])) & np.uint64((1 << others[0][1]) - 1)
                high = (f >> np.uint64(others[1][0])) & np.uint64((1 << others[1][1]) - 1)
                rest = low | (high << np.uint64(others[0][1]))
                third = width // 3
                cuts = ((0, third), (third, third), (2 * third, width - 2 * third))
                keys, _ = _signatures(rest, cuts, sig[part])
                copies = len(keys) // len(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.tile(fps[part], copies))], names=["sig", "fp"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature to forest edges. Whole signatures are compared, some ``_HELD`` rows at a time."""
    names = ["u", "v"]
    held: list[pa.RecordBatch] = []
    size = 0

    def pack(rest: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch], int]:
        sig = np.concatenate([b.column(0).to_numpy() for b in held])
        fps = np.concatenate([b.column(1).to_numpy() for b in held])
        end = len(sig) if rest else int(np.searchsorted(sig, sig[-1]))
        u, v = links_in(sig[:end], fps[:end].view(np.uint64)) if end else (np.empty(0, np.int64),) * 2
        left = pa.RecordBatch.from_arrays([pa.array(sig[end:]), pa.array(fps[end:])], names=["sig", "fp"])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=names), [left], len(sig) - end

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= _HELD:
            edges, held, size = pack(False)
            yield edges
    if size:
        yield pack(True)[0]


def _crowded(rows: DataFrame, heavy: int) -> DataFrame:
    """(sig, parts) of the signatures of more than ``heavy`` rows."""
    counts = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy)
    return written(counts.select("sig", F.ceil(F.col("n") / heavy).cast("int").alias("parts")), "heavy-signatures")


def _in_parts(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows of crowded signatures once for each pair of parts that theirs belongs to, under a key of that pair. A chance collision of
    keys only adds candidates to verify."""
    own = rows.join(crowded, "sig").withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    each = own.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.select(F.xxhash64("sig", F.least("p", "q"), F.greatest("p", "q")).alias("sig"), "fp")


def near_links(distinct: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints in column ``fp`` as all pairs within 4 bits would."""
    compare = lambda rows: rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(_compared, "u bigint, v bigint")
    index = distinct.select("fp").mapInArrow(_indexed, "sig bigint, fp bigint")
    crowded = _crowded(index, heavy)
    if crowded.isEmpty():
        return compare(index)
    light = compare(index.join(crowded, "sig", "left_anti"))
    refined = index.join(crowded, "sig", "left_semi").mapInArrow(_refined, "sig bigint, fp bigint")
    still = _crowded(refined, heavy)
    if still.isEmpty():
        return light.unionByName(compare(refined))
    return light.unionByName(compare(refined.join(still, "sig", "left_anti"))).unionByName(compare(_in_parts(refined, still)))


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root): the least fingerprint that links lead to, for each distinct fingerprint of ``prints``."""
    spark = prints.sparkSession
    # The index is many times its fingerprints; without a number of its own it would be made by the few tasks that these fill.
    parts = max(spark.sparkContext.defaultParallelism, prints.count() // _A_TASK)
    members = prints.select("fp").distinct().repartition(parts, "fp")
    roots = written(connected(near_links(members)), "components")
    return members.join(roots, members["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", share_rows: int = SHARE_ROWS) -> DataFrame:
    """key, fp and component_id: the smallest key that links lead to."""
    prints = written(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text"), "fingerprints")
    n = prints.count()
    least = written(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")), "copies")
    named = written(least.join(classes(prints), "fp").select("fp", "root", "least"), "named")
    # A component may hold a third of all fingerprints, and a fingerprint a third of all documents: both are dealt into shares.
    smallest = written(named.groupBy(F.col("root").alias("key")).agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "smallest")
    found = shared_join(named, F.col("root"), F.col("fp"), smallest.drop("n"), split_keys(smallest, n, share_rows)).select(F.col("fp").alias("key"), "component_id")
    split = split_keys(least.select(F.col("fp").alias("key"), "n"), n, share_rows)
    return shared_join(prints, F.col("fp"), F.col("key"), found, split).select(F.col("key").alias(key), "fp", "component_id")


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the smallest key (a null key after all others), of several rows with
    that key the one with the least hash of its text, and of rows alike in key and text any one."""
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    prints = written(fingerprints(source, "key", "text", ("hash",)), "fingerprints")
    order = F.struct(F.col("key").isNull().alias("none"), "key", "hash")
    per = prints.groupBy("fp").agg(F.min(order).alias("first"))
    stay = per.join(classes(prints), "fp").groupBy("root").agg(F.min("first").alias("first"))
    k, t = unused(docs, "__key", "__text")
    is_row = docs[key].eqNullSafe(F.col(k)) & (F.xxhash64(docs[text]) == F.col(t))
    kept = docs.join(stay.select(F.col("first.key").alias(k), F.col("first.hash").alias(t)).distinct(), is_row, "left_semi")
    # Only rows that agree in key and text with another one are compared as a whole.
    again = prints.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias(k), F.col("hash").alias(t))
    again = written(again, "repeated-rows")
    if again.isEmpty():
        return kept
    return kept.join(again, is_row, "left_anti").unionByName(kept.join(again, is_row, "left_semi").dropDuplicates([key, text]))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
