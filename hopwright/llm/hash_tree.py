"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks in them and shards in those. A row descends from the root; at each level every child draws
``-ln(u) / weight`` from a hash of (row key, path of the child), and the smallest draw wins, so a child is chosen in
proportion to its weight. A draw depends on the child's own path and weight alone. When one weight changes, only draws
along its path change, and rows move only into the subtree that gained, or out of the one that lost. A shard in a region
of its own therefore takes rows only into itself.

Placement reads the key alone: a null key is a key like any other, repeated keys share a shard; rows without a key share a slot
bucket too, which one task numbers. Null texts have size 1 and crc32 0; texts of any length are measured whole. Slots number the rows of a shard without gaps: rows are ordered by a hash bucket, then key, size and crc32;
each bucket is numbered on its own and shifted by the sizes of the buckets before it, so no task holds a whole shard.
Rows alike in key, size and crc32 get their slots in any order. An empty table gives an empty result. Columns of the input beyond
key and text are not read and may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopwright.llm.common import table

#: Hash buckets for the slots; a shard's buckets fit one small window.
SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Node:
    name: str
    weight: float = 0.0
    shard: int | None = None
    children: tuple["Node", ...] = field(default=())

    @property
    def total(self) -> float:
        return self.weight if self.shard is not None else sum(c.total for c in self.children)


def default_tree(shards: int, per_rack: int = 2, racks: int = 2, weights: dict[int, float] | None = None) -> Node:
    """Shards filled into racks and regions in order of their number; a full region makes the next shard open a new one."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    per_region = per_rack * racks
    regions = []
    for r in range(0, shards, per_region):
        inner = []
        for k in range(r, min(r + per_region, shards), per_rack):
            leaves = tuple(Node(f"shard{s}", (weights or {}).get(s, 1.0), s) for s in range(k, min(k + per_rack, shards)))
            inner.append(Node(f"rack{(k - r) // per_rack}", children=leaves))
        regions.append(Node(f"region{r // per_region}", children=tuple(inner)))
    return Node("root", children=tuple(regions))


def _draw(key: Column, path: Column, weight: Column) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(path, F.lit("|"), key).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def _levels(node: Node, path: str = "", depth: int = 0, out: dict | None = None) -> dict[int, list[tuple[str, Node]]]:
    out = {} if out is None else out
    if node.children:
        out.setdefault(depth, []).append((path or node.name, node))
        for c in node.children:
            _levels(c, f"{path or node.name}/{c.name}", depth + 1, out)
    return out


def place(df: DataFrame, tree: Node, key: Column, out: str) -> DataFrame:
    """``df`` with the shard of each row as int column ``out``; the tree travels as one constant of its children by path."""
    at = f"__{out}_at"
    df = df.withColumn(at, F.lit(tree.name))
    levels = _levels(tree)
    for depth in sorted(levels):
        kids = F.create_map(
            *(
                x
                for path, node in levels[depth]
                for x in (F.lit(path), F.array(*(F.struct(F.lit(f"{path}/{c.name}").alias("p"), F.lit(float(c.total)).alias("w")) for c in node.children if c.total > 0)))
            )
        )
        draws = F.transform(F.try_element_at(kids, F.col(at)), lambda c: F.struct(_draw(key, c["p"], c["w"]).alias("d"), c["p"].alias("p")))
        df = df.withColumn(at, F.coalesce(F.array_min(draws)["p"], F.col(at)))
    numbers = F.create_map(*(x for d in levels for path, n in levels[d] for c in n.children if c.shard is not None for x in (F.lit(f"{path}/{c.name}"), F.lit(c.shard))))
    return df.withColumn(out, F.element_at(numbers, F.col(at)).cast("int")).drop(at)


def key_text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("null"))


def shard_rows(docs: DataFrame, tree: Node, grown: Node, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with size, text_crc32, law, shard, slot and grown_shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit("slot|"), key_text(key)).cast("binary")), 1, 3), 16, 10).cast("int")
    slim = docs.select(
        F.col(key), (F.octet_length(body).cast("bigint") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), bucket.alias("__bucket")
    )
    rows = place(place(slim, tree, key_text(key), "shard"), grown, key_text(key), "grown_shard")
    counts = place(docs.select(F.col(key), bucket.alias("__bucket")), tree, key_text(key), "shard").groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__bucket").orderBy(F.col(key).asc_nulls_first(), "size", "text_crc32")
    numbered = rows.withColumn("__rank", F.row_number().over(within))
    # At most shards x SLOT_BUCKETS rows, whatever the input.
    return numbered.join(F.broadcast(starts), ["shard", "__bucket"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__start") + F.col("__rank") - 1).cast("bigint").alias("slot"), "grown_shard"
    )


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), default_tree(8), default_tree(9))


def _sql_pick(prefix: str, key: str, tree: Node) -> str:
    """The descent in SQL: one CASE per level."""
    levels = _levels(tree)
    at, steps = "'root'", []
    for depth in sorted(levels):
        cases = []
        for path, node in levels[depth]:
            draw = lambda c, path=path: f"-ln((('0x' || substr(md5('{path}/{c.name}|' || {key}), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / {float(c.total)!r}"
            picks = [f"{{'d': {draw(c)}, 'p': '{path}/{c.name}'}}" for c in node.children]
            pick = f"least({', '.join(picks)}).p" if len(picks) > 1 else f"'{path}/{node.children[0].name}'"
            cases.append(f"WHEN {at} = '{path}' THEN {pick}")
        steps.append(f"CASE {' '.join(cases)} ELSE {at} END AS {prefix}{depth}")
        at = f"{prefix}{depth}"
    return steps, at


def op4_sql() -> str:
    a, at_a = _sql_pick("a", "k", default_tree(8))
    b, at_b = _sql_pick("b", "k", default_tree(9))
    rounds = ", ".join(f"r{i} AS (SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM r{i - 1})" for i in range(1, 9))
    return f"""
    WITH r0 AS (SELECT range AS b, range::BIGINT AS c FROM range(256)), {rounds},
    crc AS (SELECT list(c ORDER BY b) AS t FROM r8),
    base AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
    placed AS (SELECT doc_id, x, k, ('0x' || substr(md5('slot|' || k), 1, 3))::INTEGER AS bucket, {', '.join(a)}, {', '.join(b)} FROM base),
    bytes AS (SELECT *, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::BIGINT) AS l, strlen(x) + 1 AS size FROM placed),
    hashed AS (SELECT bytes.*, xor(list_reduce(l, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM bytes, crc),
    named AS (SELECT *, regexp_extract({at_a}, 'shard([0-9]+)$', 1)::INTEGER AS shard, regexp_extract({at_b}, 'shard([0-9]+)$', 1)::INTEGER AS grown_shard FROM hashed)
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
    FROM named
    """
