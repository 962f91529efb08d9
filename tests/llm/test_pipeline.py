"""The pipeline against the same stages done with SQL and, for near-duplicates, by brute force."""

import numpy as np
import oracle
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from hopwright.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_pipeline_by_other_means(spark):
    con = oracle.connect(SF)
    docs = con.execute("SELECT * FROM documents").fetchdf()

    def ask(name):
        con.execute("DROP VIEW IF EXISTS documents")
        con.register("now", docs)
        con.execute("CREATE VIEW documents AS SELECT * FROM now")
        return con.execute(queries.SQL[name]).fetchdf()

    verdict = ask("op2_divergence")
    docs = docs[docs.doc_id.isin(verdict[verdict.kept].doc_id)]
    fps = np.array([brute_fingerprint(t) for t in docs.text], np.uint64)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    group = simhash.spanning(len(fps), a, b)
    docs = docs.assign(group=group).sort_values("doc_id").drop_duplicates("group").drop(columns="group")
    marks = ask("op9_decontaminate")
    docs = docs[~docs.doc_id.isin(marks[marks.contaminated].doc_id)]
    copies = ask("op8_poisson_mix")
    docs = copies[["doc_id"]].merge(docs, on="doc_id")
    want = ask("op4_hash_tree")
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert oracle.plain(got) == oracle.plain(want) and len(got) > 20


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_one_row_of_each_group_stays(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(2, x), (5, y), (5, x), (7, z), (7, z.upper()), (None, x), (None, y), (9, None), (10, ""), (11, ""), (None, None), (2, x), (2, x)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", "text", F.lit(1).alias("__key"), F.lit("fp").alias("fp"), F.lit(2).alias("__text"), F.lit(3).alias("hash"))
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id, (r.text or "").lower()) for r in got.collect())
    assert kept == [(2, x), (5, y), (7, z), (9, "")]
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs.filter("doc_id is null and text is not null"), SF).collect()] == [None, None]


def test_stages_take_hostile_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.filter("length(text) > 500").first().text
    rows = [(None, None, None, None), (None, "", "en", ""), (-1, text, None, "s"), (-1, text, None, "s"), (-1, text + " more", "en", None), (-2, "a b c", "xx", "s"), (-3, (text + " ") * 400, "en", "s")]
    hostile = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    names = ["__key", "__here", "__q_kept", "__s", "fp", "key"]
    hostile = docs.limit(60).select("doc_id", "text", "lang", "source", "n_chars").unionByName(hostile).withColumns({n: F.lit(n) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, hostile, SF)
        assert out.columns == hostile.columns, name
        assert all(r[n] == n for r in out.select(*names).collect() for n in names), name
    assert {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, hostile, SF).filter("doc_id < 0").collect()} == {-1}
    assert corpus_pipeline.STAGES[-1][1](spark, hostile, SF).count() == hostile.count()
