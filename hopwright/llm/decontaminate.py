"""Benchmark decontamination by a prefix-filtered set join.

An item gives windows of 13 consecutive words (one shorter window if it has fewer). A window is taken as the ordered set of
its five-word shingles (of the whole window if it is shorter), and shingles are ordered by rarity: the sum of the logarithms
of their words' counts in all documents. A document that holds a window holds all its shingles, so for full containment the
prefix is the rarest shingle alone, and only those are joined. A match fixes where the window would have to start: it has to
start at or after the first word and end at or before the last (position and length bounds), and then the words there are
compared with the window's, one by one.

Documents are read once for the counts and once for the join, whatever the benchmark's size. In the second pass a row looks its
shingles up in a bitmap of the prefixes' hashes, one array of at most ``1 << MAX_BITS`` bits that is broadcast; what passes leaves
the row and meets the prefixes in an equality join. A fuller bitmap lets more chance candidates through, which the join drops.

Null and empty texts have no words, are hit nowhere and never contaminated; an item without words has no windows; an item
without an id hits but isn't counted among the items. Repeated documents give repeated rows. Empty tables on either side give
an empty result or clean documents. Of shingles of equal rarity a window's first one is its prefix. Texts of any length are taken
whole. Only key and text are read; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopwright.llm.common import ascii_lower, keep_where, table, unused, words_of, written

#: The contract's [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, said by classes: Java's matcher takes many times as long over the negated ranges.
WORDS = r"[\P{ASCII}\p{Lower}\p{Digit}]+"
WINDOW = 13
SHINGLE = 5
#: Bits of the bitmap to a prefix, and the logarithms of its least and largest size: 8 KB to 8 MB.
SPARSE = 16
MIN_BITS, MAX_BITS = 16, 26
#: Up to so many distinct words of the benchmark (8 bytes each) are broadcast for the counts.
VOCABULARY = 200_000


def words(text: str) -> Column:
    return words_of(ascii_lower(F.coalesce(F.col(text), F.lit(""))), WORDS)


def windows(items: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows: ``win`` (words), ``len`` and ``items`` (the ids that have it)."""
    w = items.select(F.col(item).alias("item"), words(text).alias("w")).filter(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(size)))
    each = w.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    return each.select("item", "len", F.slice("w", F.col("i"), F.col("len")).alias("win")).groupBy("win", "len").agg(F.collect_set("item").alias("items"))


def word_counts(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(word hash ``k``, count ``n``) over all documents, for the words of the windows."""
    wanted = found.select(F.explode("win").alias("w")).select(F.xxhash64("w").alias("k")).distinct()
    seen = docs.select(F.explode(words(text)).alias("w")).select(F.xxhash64("w").alias("k"))
    if wanted.limit(VOCABULARY + 1).count() <= VOCABULARY:
        return seen.join(F.broadcast(wanted), "k", "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return seen.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(wanted, "k", "left_semi")


def _shingle(x: Column, w: Column, i: Column, s: int) -> Column:
    return F.xxhash64(x, *(F.get(w, i + k) for k in range(1, s)))


def prefixes(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per window with its rarest shingle: ``s`` words, their hash ``h``, offset ``o`` in the window ``win`` of ``len`` words,
    the items that have it, and ``j``, which numbers the windows of one shingle from 1."""
    found = written(windows(items, item, item_text, size), "windows")
    counts = word_counts(docs, found, text)
    parts = found.select("win", "len", "items", F.least("len", F.lit(SHINGLE)).alias("s")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("s"))))
    parts = parts.withColumn("sh", F.slice("win", F.col("o") + 1, F.col("s")))
    rows = parts.select("win", "len", "items", "s", "o", F.explode("sh").alias("w")).withColumn("k", F.xxhash64("w")).join(counts, "k", "left")
    rare = rows.groupBy("win", "len", "items", "s", "o").agg(F.round(F.sum(F.log1p(F.coalesce("n", F.lit(0)).cast("double"))), 6).alias("rarity"))
    best = rare.groupBy("win", "len", "items", "s").agg(F.min(F.struct("rarity", "o")).alias("best")).withColumn("o", F.col("best.o")).drop("best")
    first, all_words = F.element_at("win", F.col("o") + 1), F.col("win")
    hashes = None
    for s in range(1, SHINGLE + 1):
        h = _shingle(first, all_words, F.col("o"), s)
        hashes = F.when(F.col("s") == s, h) if hashes is None else hashes.when(F.col("s") == s, h)
    numbered = F.row_number().over(Window.partitionBy("s", "h").orderBy(F.xxhash64("win"), "len"))
    return written(best.withColumn("h", hashes).withColumn("j", numbered), "prefixes")


def bitmap(found: DataFrame, max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """One row with the bits that the prefixes' hashes set, as whole numbers of 64 bits, and how many numbers there are."""
    bits = min(max_bits, max(MIN_BITS, (SPARSE * found.count()).bit_length()))
    words = 1 << (bits - 6)
    at = F.shiftright(F.col("h"), 6).bitwiseAND(F.lit(words - 1)).alias("at")
    # bit_or of single bits; the sign bit is the 64th.
    one = F.element_at(F.array(*(F.lit((1 << b) - (1 << 64) * (b == 63)) for b in range(64))), (F.col("h").bitwiseAND(F.lit(63)) + 1).cast("int"))
    set_ = found.select(at, one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("v"))
    every = found.sparkSession.range(words).join(set_, F.col("id") == F.col("at"), "left").select("id", F.coalesce("v", F.lit(0).cast("bigint")).alias("v"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("__bits")), words


def _matches(w: Column, s: int, words: int) -> Column:
    """Places of the document's shingles that may be prefixes, with the words around each: as many as a window can reach."""
    starts = F.slice(w, 1, F.greatest(F.size(w) - (s - 1), F.lit(0)))
    hashes = F.transform(starts, lambda x, i: _shingle(x, w, i, s))
    set_ = lambda h: F.getbit(F.get(F.col("__bits"), F.shiftright(h, 6).bitwiseAND(F.lit(words - 1)).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1
    places = F.array_compact(F.transform(hashes, lambda h, i: F.when(set_(h), F.struct(h.alias("h"), i.alias("i")))))
    reach = WINDOW - s
    around = lambda i: F.slice(w, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + WINDOW)
    return F.transform(places, lambda x: F.struct(F.lit(s).alias("s"), x["h"].alias("h"), x["i"].alias("i"), around(x["i"]).alias("near")))


def contamination(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256 and contaminated of each document, given ``prefixes``."""
    base = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__text"), words(text).alias("__w"))
    sizes = sorted(r["s"] for r in found.select("s").distinct().collect())  # 1 to 5
    if sizes:
        bits, n = bitmap(found, max_bits)
        base = base.join(F.broadcast(bits))
        matches = F.concat(*(_matches(F.col("__w"), s, n) for s in sizes))
    else:
        matches = F.expr("cast(null as array<struct<s:int,h:bigint,i:int,near:array<string>>>)")
    some = base.select("__key", "__text", F.size("__w").alias("__n"), matches.alias("__m"))
    some = some.select("__key", "__text", "__n", F.posexplode_outer("__m").alias("__at", "__c"))
    some = some.select("__key", "__text", "__n", (F.coalesce("__at", F.lit(0)) == 0).alias("__first"), F.col("__c.s").alias("s"), F.col("__c.h").alias("h"), F.col("__c.i").alias("i"), F.col("__c.near").alias("near"))
    rows = some.join(found, ["s", "h"], "left")
    start, near_from = F.col("i") - F.col("o"), F.greatest(F.col("i") - (F.lit(WINDOW) - F.col("s")), F.lit(0))
    inside = (start >= 0) & (start + F.col("len") <= F.col("__n"))
    holds = inside & (F.when(inside, F.slice("near", start - near_from + 1, F.col("len"))) == F.col("win"))
    hit = F.when(holds, F.struct(start.alias("a"), F.col("len").alias("len"), F.col("items").alias("items")))
    copy = (F.col("__first") & (F.coalesce("j", F.lit(1)) == 1)).cast("bigint")
    # One group is one text; its rows are counted and given back as often. A text has at most one hit of each length a place.
    per = rows.select("__key", "__text", "__n", copy.alias("__one"), hit.alias("__hit")).groupBy("__key", "__text", "__n").agg(F.sum("__one").alias("__copies"), F.collect_set("__hit").alias("__h"))
    spans = F.array_sort(F.transform("__h", lambda x: F.struct(x["a"].alias("a"), x["len"].alias("len"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    add = lambda s, x: F.struct(
        F.greatest(s["end"], x["a"] + x["len"]).alias("end"), (s["sum"] + F.greatest(F.lit(0), x["a"] + x["len"] - F.greatest(s["end"], x["a"]))).alias("sum")
    )
    per = per.withColumns(
        {
            "n_words": F.col("__n").cast("bigint"),
            "n_hit": F.aggregate(spans, zero, add, lambda s: s["sum"]).cast("bigint"),
            "__items": F.array_distinct(F.flatten(F.transform("__h", lambda x: x["items"]))),
        }
    )
    names = F.array_join(F.array_sort(F.transform("__items", lambda x: x.cast("string"))), ",")
    per = per.select(
        F.col("__key").alias(key), "n_words", "n_hit", F.size("__items").cast("bigint").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "__copies", "__text",
    )
    return per.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).drop("__copy", "__copies")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    k, t = unused(docs, "__key", "__text")
    found = contamination(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), prefixes(docs, items, text), "key", "text")
    marks = keep_where(found, F.col("contaminated")).select(F.col("key").alias(k), F.col("__text").alias(t)).distinct()
    return docs.join(marks, docs[key].eqNullSafe(F.col(k)) & (F.xxhash64(docs[text]) == F.col(t)), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return contamination(docs, prefixes(docs, items)).drop("__text")


def op9_sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
    WITH b AS (SELECT item_id, regexp_extract_all({low}, '{word}') AS w FROM benchmark),
    bl AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
    d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({low}, '{word}') AS w FROM documents),
    dw AS (SELECT row, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bl))),
    m AS (SELECT row, i, n, item_id FROM dw JOIN bw USING (n, win)),
    h AS (SELECT row, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM m) GROUP BY row),
    t AS (SELECT row, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM m GROUP BY row)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN h USING (row) LEFT JOIN t USING (row)
    """
