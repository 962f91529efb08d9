"""Quality rules by distribution divergence.

Each language has a reference: the mean mix of character classes of all its documents, and the shares of its most common
words with everything else as one more share. A document's own histograms are compared with its language's reference by
the Jensen-Shannon distance (base 2, so 0 to 1). Shouting, symbol noise and digits move the character classes; word lists,
stuttering and text in another language move the common words. Documents below a length guard are not judged that way, as
short texts differ by chance.

All of it is built-in functions on one row at a time; only the references are aggregated, from all documents. A reference
row holds a few dozen numbers. Up to ``MAX_LANGUAGES`` languages the references are broadcast; beyond that the rows are
joined by salted language.

Null text counts as empty; a null language is a language of its own. Texts of any length are taken whole. Of words that are equally
common the first by its letters counts as the more common one. Repeated rows give repeated results. An empty table gives an empty
result. Other columns are carried through ``judge`` and not read; its own begin with '__q_' and '__r_' and replace such columns of the
input. ``passing`` gives the input's columns alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopwright.llm.common import boxed, keep_where, table, words_of

COMMON_WORDS = 16
MIN_WORDS = 50
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.42
MAX_LANGUAGES = 4096
SALTS = 64
WINDOW = 5
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
CLASSES = ("letters", "upper", "space", "digits", "punctuation", "other")

_P = "__q_"


def _removed(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def with_counts(df: DataFrame, text: str = "text", prefix: str = _P, with_words: bool = True) -> DataFrame:
    """``df`` with the words of the text, its base counts and its character classes, under prefixed names. Without words the classes
    are counted in a way that doesn't need them."""
    p = prefix
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({f"{p}words": words_of(body)})
    # Most characters are small letters and white space; what is told apart further is a short rest.
    df = df.withColumns(
        {
            f"{p}n_words": F.size(f"{p}words").cast("bigint"),
            f"{p}word_chars": F.length(F.array_join(f"{p}words", "") if with_words else _removed(body, " \t\n\x0b\x0c\r")).cast("bigint"),
            f"{p}n_chars": F.length(body).cast("bigint"),
            f"{p}rest": F.regexp_replace(body, r"[\p{Ll}\p{M}\x20\x09-\x0D]+", ""),
        }
    )
    df = df.withColumns({f"{p}plain": F.regexp_replace(f"{p}rest", r"[\p{L}\p{M}]+", ""), f"{p}upper": F.length(F.regexp_replace(f"{p}rest", r"\P{Lu}+", "")).cast("bigint")}).drop(f"{p}rest")
    plain = F.col(f"{p}plain")
    n_plain = F.length(plain)
    return df.withColumns(
        {
            f"{p}n_symbols": (n_plain - F.length(_removed(plain, SYMBOLS))).cast("bigint"),
            f"{p}digits": (n_plain - F.length(_removed(plain, "0123456789"))).cast("bigint"),
            f"{p}punctuation": (n_plain - F.length(_removed(plain, PUNCTUATION))).cast("bigint"),
            f"{p}space": F.col(f"{p}n_chars") - F.col(f"{p}word_chars"),
            f"{p}n_plain": n_plain.cast("bigint"),
        }
    ).drop(f"{p}plain").withColumns(
        {
            f"{p}letters": F.col(f"{p}word_chars") - F.col(f"{p}n_plain") - F.col(f"{p}upper"),
            f"{p}other": F.col(f"{p}n_plain") - F.col(f"{p}digits") - F.col(f"{p}punctuation"),
        }
    )


def _class_counts(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in CLASSES]


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON_WORDS) -> DataFrame:
    """One row per language: ``__r_lang``, the class shares and the common words with their shares, over all documents."""
    p = _P
    tongue = F.coalesce(F.col(lang), F.lit("")).alias("__r_lang")
    classes = with_counts(docs.select(tongue, F.col(text)), text, with_words=False).groupBy("__r_lang").agg(*(F.sum(f"{p}{c}").alias(c) for c in CLASSES))
    total = sum((F.col(c) for c in CLASSES), F.lit(0))
    classes = classes.select("__r_lang", F.array(*(F.try_divide(F.col(c).cast("double"), total.cast("double")) for c in CLASSES)).alias("__r_classes"))
    words = docs.select(tongue, F.explode(words_of(F.coalesce(F.col(text), F.lit("")))).alias("word"))
    counts = words.groupBy("__r_lang", "word").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("__r_lang").agg(F.sum("n").alias("all"))
    order = Window.partitionBy("__r_lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= common)
    top = top.groupBy("__r_lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    listed = top.join(totals, "__r_lang").select(
        "__r_lang", F.transform("top", lambda t: F.xxhash64(t["word"])).alias("__r_words"), F.transform("top", lambda t: t["n"] / F.col("all")).alias("__r_shares")
    )
    return classes.join(listed, "__r_lang", "left")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def judge(docs: DataFrame, refs: DataFrame, text: str = "text", lang: str = "lang", min_words: int = MIN_WORDS, broadcast: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` and, under the prefix ``__q_``, the counts, both distances, base_failed and kept."""
    p = _P
    df = with_counts(docs, text)
    df = df.withColumns({f"{p}hashes": F.transform(f"{p}words", lambda w: F.xxhash64(w)), f"{p}lang": F.coalesce(F.col(lang), F.lit(""))})
    h = F.col(f"{p}hashes")
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({f"{p}lines": lines})
    # Windows of 5 words by hash, then the places of those that occur again.
    window = lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW)))
    df = df.withColumns({f"{p}grams": F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), window)})
    grams = F.col(f"{p}grams")
    again = F.size(F.array_distinct(grams)) < F.size(grams)
    df = df.withColumns(
        {
            f"{p}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("bigint"),
            f"{p}sorted": F.when(again, F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))),
        }
    )
    s = F.col(f"{p}sorted")
    same = lambda x, i: F.get(s, i)["g"].eqNullSafe(x["g"])
    twin = lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"])
    df = df.withColumns({f"{p}places": F.sort_array(F.filter(F.transform(s, twin), lambda x: x.isNotNull()))})
    places = F.col(f"{p}places")
    covered = F.aggregate(
        F.transform(places, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    df = df.withColumns({f"{p}n_repeat_words": F.coalesce(covered, F.lit(0).cast("bigint"))}).drop(f"{p}sorted", f"{p}places", f"{p}grams", f"{p}lines")
    if broadcast:
        df = df.join(F.broadcast(refs), F.col(f"{p}lang") == F.col("__r_lang"), "left")
    else:
        salted = refs.withColumn("__r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        df = df.withColumn(f"{p}salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")).join(salted, (F.col(f"{p}lang") == F.col("__r_lang")) & (F.col(f"{p}salt") == F.col("__r_salt")), "left")
        df = df.drop(f"{p}salt", "__r_salt")
    n_words, words = F.col(f"{p}n_words"), F.col("__r_words")
    long_enough = n_words >= min_words
    df = df.withColumns({f"{p}common": F.when(long_enough & words.isNotNull(), F.filter(h, lambda x: F.array_contains(words, x)))})
    common, n_chars = F.col(f"{p}common"), F.col(f"{p}n_chars").cast("double")
    share = lambda r: F.size(F.filter(common, lambda x: x == r)) / n_words
    own = F.concat(F.transform(words, share), F.array(1 - F.size(common) / n_words))
    rest = F.array(F.greatest(F.lit(0.0), 1 - F.aggregate("__r_shares", F.lit(0.0), lambda a, x: a + x)))
    df = df.withColumns(
        {
            f"{p}char_distance": F.when(long_enough, js_distance(F.array(*(F.try_divide(c.cast("double"), n_chars) for c in _class_counts(p))), F.col("__r_classes"))),
            f"{p}word_distance": F.when(common.isNotNull(), js_distance(own, F.concat("__r_shares", rest))),
            f"{p}base_failed": (n_words < 10) | (100 * F.col(f"{p}n_repeat_words") > 20 * n_words),
        }
    )
    fits = (F.coalesce(F.col(f"{p}char_distance"), F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce(F.col(f"{p}word_distance"), F.lit(0.0)) <= MAX_WORD_DISTANCE)
    df = df.withColumns({f"{p}kept": ~F.col(f"{p}base_failed") & fits})
    return df.drop("__r_lang", "__r_classes", "__r_words", "__r_shares", f"{p}common", f"{p}hashes", f"{p}words", f"{p}lang")


def quality(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``judge`` against the references of the same documents."""
    few = docs.select(F.coalesce(F.col(lang), F.lit(""))).distinct().limit(MAX_LANGUAGES + 1).count() <= MAX_LANGUAGES
    return judge(docs, references(docs, text, lang), text, lang, broadcast=few)


def passing(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names."""
    found = quality(boxed(docs, F.col(text).alias("text"), F.col(lang).alias("lang")))
    return keep_where(found, F.col(f"{_P}kept")).select("__row.*")


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    p = _P
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality(docs).select("doc_id", *(F.col(f"{p}{c}").alias(c) for c in counts), *(F.round(f"{p}{c}", 6).alias(c) for c in ("char_distance", "word_distance")))


def op2_sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    strip = lambda chars, c="plain": "length(translate(" + c + ", '" + chars.replace("'", "''") + "', ''))"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    term = f"({part('a', 'b')} + {part('b', 'a')})"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS x, coalesce(lang, '') AS lang FROM documents),
    w AS (SELECT *, regexp_extract_all(x, '{word}') AS words, regexp_replace(x, '[\p{{L}}\p{{M}}\x20\x09-\x0D]+', '', 'g') AS plain FROM d),
    c AS (SELECT *, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(x)::BIGINT AS n_chars,
                 length(regexp_replace(x, '\P{{Lu}}+', '', 'g'))::BIGINT AS upper, length(plain)::BIGINT AS n_plain,
                 (length(plain) - {strip(SYMBOLS)})::BIGINT AS n_symbols, (length(plain) - {strip('0123456789')})::BIGINT AS digits, (length(plain) - {strip(PUNCTUATION)})::BIGINT AS punctuation,
                 list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
          FROM w),
    e AS (SELECT *, word_chars - n_plain - upper AS letters, n_chars - word_chars AS space, n_plain - digits - punctuation AS other FROM c),
    tokens AS (SELECT row, lang, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM e),
    grams AS (SELECT row, i, n, word || ' ' || a || ' ' || b || ' ' || c || ' ' || d AS g FROM (
        SELECT *, count(*) OVER (PARTITION BY row) AS n, lead(word, 1) OVER o AS a, lead(word, 2) OVER o AS b, lead(word, 3) OVER o AS c, lead(word, 4) OVER o AS d
        FROM tokens WINDOW o AS (PARTITION BY row ORDER BY i)) WHERE d IS NOT NULL),
    twins AS (SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, g) AS k FROM grams) WHERE k > 1),
    repeats AS (SELECT row, sum(least(5, coalesce(next - i, 5)))::BIGINT AS n_repeat_words FROM (SELECT *, lead(i) OVER (PARTITION BY row ORDER BY i) AS next FROM twins) GROUP BY row),
    ref AS (SELECT lang, sum(letters) AS l0, sum(upper) AS l1, sum(space) AS l2, sum(digits) AS l3, sum(punctuation) AS l4, sum(other) AS l5, sum(n_chars) AS t FROM e GROUP BY lang),
    totals AS (SELECT lang, count(*) AS total FROM tokens GROUP BY lang),
    top AS (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM (SELECT lang, word, count(*) AS n FROM tokens GROUP BY ALL)),
    common AS (SELECT lang, word, rank, n / total AS share FROM top JOIN totals USING (lang) WHERE rank <= {COMMON_WORDS}),
    own AS (SELECT row, lang, word, count(*) AS k FROM tokens JOIN common USING (lang, word) GROUP BY ALL),
    pairs AS (SELECT e.row, coalesce(k, 0) / n_words AS a, share AS b FROM e JOIN common USING (lang) LEFT JOIN own USING (row, lang, word) WHERE n_words >= {MIN_WORDS}),
    rests AS (SELECT row, greatest(0, 1 - sum(a)) AS a, greatest(0, 1 - sum(b)) AS b FROM pairs GROUP BY row),
    wd AS (SELECT row, sqrt(greatest(0, sum({term}) / 2)) AS word_distance FROM (FROM pairs UNION ALL FROM rests) GROUP BY row),
    cd AS (SELECT row, sqrt(greatest(0, sum({term}) / 2)) AS char_distance FROM (
        SELECT row, unnest([letters, upper, space, digits, punctuation, other]) / n_chars AS a, unnest([l0, l1, l2, l3, l4, l5]) / t AS b FROM e JOIN ref USING (lang) WHERE n_words >= {MIN_WORDS}) GROUP BY row),
    r AS (SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, char_distance, word_distance
          FROM e LEFT JOIN repeats USING (row) LEFT JOIN wd USING (row) LEFT JOIN cd USING (row))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(char_distance, 0) <= {MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} AS kept,
           round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
    FROM r
    """
