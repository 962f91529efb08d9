"""The operators on hand-made rows: brute force, round trips, and what a hostile table may hold."""

import base64
import hashlib
import io
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hopwright.llm import decontaminate, divergence, hash_tree, line_dedup, mixing, pitman_yor, simhash, site_template, token_prefix, warc_zstd
from hopwright.llm.common import ascii_lower, words_of
from hopwright.llm.components import connected

LONG = "lorem ipsum dolor " * 20_000
#: Null and empty texts, ties, repeated rows, a null key, a very long text; and columns whose names operators use themselves.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 5), (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 5),
    (2, None, "en", "a", 1), (3, "", None, None, None), (None, "words of no key at all but quite a few of them here", "en", "b", 2), (4, LONG, "en", "b", 3),
    (5, "\n\n \t", "xx", "b", 0), (6, "é ü 漢字 🙂 " * 30, "fr", "c", 9), (7, "A" * 5000, "en", "a", 7),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_words bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({"shard": F.lit("x"), "kept": F.lit(1), "score": F.lit("s"), "fp": F.lit(0), "h": F.lit(0), "block": F.lit("b"), "near": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def words(text):
    return (text or "").encode().split()


def test_divergence_base_counts_by_brute_force(spark, docs, nothing):
    got = divergence.quality(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        w = words(r.text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (r.text or "").split("\n") if x.encode().split()]
        assert r["__q_n_words"] == len(w) and r["__q_n_repeat_words"] == len(hit)
        assert r["__q_n_dup_lines"] == len(lines) - len(set(lines)) and r["__q_word_chars"] == sum(len(x.decode()) for x in w)
        assert r["__q_base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r["__q_base_failed"] and r["__q_kept"])
    assert divergence.quality(nothing).count() == 0


def test_js_distance(spark):
    f = lambda p, q: spark.range(1).select(divergence.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    assert f([0.5, 0.5], [0.5, 0.5]) == 0 and math.isclose(f([1.0, 0.0], [0.0, 1.0]), 1.0)
    m = 0.5 * math.log2(0.5 / 0.375) + 0.5 * math.log2(0.5 / 0.625) + 0.25 * math.log2(0.25 / 0.375) + 0.75 * math.log2(0.75 / 0.625)
    assert math.isclose(f([0.5, 0.5], [0.25, 0.75]), math.sqrt(m / 2))


def test_divergence_salted_join_gives_the_same(spark, docs):
    refs = divergence.references(docs)
    pick = lambda b: sorted(map(str, divergence.judge(docs, refs, broadcast=b).select("doc_id", "__q_kept", F.round("__q_char_distance", 9)).collect()))
    assert pick(True) == pick(False)


def test_hash_tree_moves_rows_only_into_the_new_shard(spark, docs, nothing):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = hash_tree.shard_rows(many, hash_tree.default_tree(8), hash_tree.default_tree(9)).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in rows) and {r.shard for r in rows} == set(range(8))
    moved = sum(r.grown_shard == 8 for r in rows) / len(rows)
    assert abs(moved - 1 / 9) < 0.01 and max(Counter(r.shard for r in rows).values()) < 1.1 * len(rows) / 8
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    got = hash_tree.shard_rows(docs, hash_tree.default_tree(8), hash_tree.default_tree(9)).collect()
    assert sorted((r["size"], r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in ROWS)
    assert hash_tree.shard_rows(nothing, hash_tree.default_tree(8), hash_tree.default_tree(9)).count() == 0


def test_hash_tree_weight_change_is_confined(spark):
    many = spark.range(5000).select(F.col("id").alias("doc_id"))
    place = lambda w: {r.doc_id: r.s for r in hash_tree.place(many, hash_tree.default_tree(8, weights=w), hash_tree.key_text("doc_id"), "s").collect()}
    before, after = place({}), place({2: 3.0})
    # Shards 0 to 3 are one region, 2 and 3 one rack: between the regions rows move only into the first.
    assert all(after[k] // 4 == 0 for k in before if before[k] != after[k]) and any(before[k] != after[k] for k in before)


def test_simhash_by_brute_force(spark, docs, nothing):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(60)) for _ in range(12)]
    texts = base + [b.replace(b.split()[7], "zzz", 1) for b in base] + [base[0]] * 30 + [None, "", "one", "ONE two three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    def ref(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = np.array([ref(t) for t in texts], np.uint64)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    want = simhash.spanning(len(fps), a, b)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (int(fps[i]), int(want[i])) for i in range(len(texts))}
    split = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df, share_rows=5).collect()}
    assert split == got
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(ROWS) and {r.component_id for r in out if r.doc_id in (2, 3, 5)} == {2}
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_crowded_signatures_lose_no_link(spark):
    rng = np.random.default_rng(2)
    fps = set()
    for b in rng.integers(0, 2**63, 2, dtype=np.uint64):
        for _ in range(300):
            x = int(b)
            for k in rng.choice(64, rng.integers(0, 8), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    want = simhash.spanning(len(fps), a, b)
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    df = spark.createDataFrame([(k,) for k in place], "fp bigint")
    for heavy in (10**9, 40, 3):
        e = simhash.near_links(df, heavy).collect()
        got = simhash.spanning(len(fps), np.array([place[r.u] for r in e]), np.array([place[r.v] for r in e]))
        assert (got == want).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}
    assert connected(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_token_prefixes_match_the_library(spark, docs, nothing):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public.path("byte_bpe_50k.json"))
    lib, own = Tokenizer.from_file(path), token_prefix.counter(path)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for t in ("", "Hello  world", "we'll 'l'll it's", "a<|endoftext|>b!<|endo", "  \n\n x　 y", "漢字カナ🙂é", "aaaaaaaa" * 40, "12345 67,8%%%###"):
        assert own.count(t) == count(t)
        prefixes = own.at_prefixes(t)
        assert prefixes == [count(t[:k]) for k in range(len(t) + 1)]
        k = own.longest_within(t, 5, prefixes)
        assert count(t[:k]) <= 5 and (k == len(t) or min(prefixes[k + 1 :]) > 5 or prefixes[k + 1] > 5)
        for budget in (0, 1, 2, 3, 5, 8):
            assert own.count_and_cut(t, budget) == (count(t), own.longest_within(t, budget, prefixes))
    with pytest.raises(ValueError):
        token_prefix.refuse_other_rules({"normalizer": {"type": "NFC"}, "pre_tokenizer": {"type": "ByteLevel"}, "model": {}, "added_tokens": []})
    got = token_prefix.count_tokens(docs, path).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((len((t or "").encode()), count(t or ""), count(t or "") > 1024) for _, t, *_ in ROWS)
    assert token_prefix.count_tokens(nothing, path).count() == 0


def test_mixing_means_and_repeats(spark, docs, nothing):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "small").otherwise("big").alias("source"))
    got = mixing.mix(df, weights={"small": 3.0, "big": 1.0})
    n = {r.source: r.n for r in got.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(n["small"] / 22_500 - 1) < 0.03 and abs(n["big"] / 7_500 - 1) < 0.05
    key = lambda x: sorted((r.doc_id, r["__copy"], r["__order"]) for r in x.collect())
    assert key(got) == key(mixing.mix(df.repartition(5), weights={"small": 3.0, "big": 1.0}))
    order = [r["__order"] for r in got.collect()]
    assert order == sorted(order)
    far = mixing.mix(df.limit(2000), weights={"small": 1.0, "big": 1.0}, total=80_000).count()
    assert abs(far / 80_000 - 1) < 0.03
    few = lambda f: sorted((str(r.doc_id), r["__copy"]) for r in mixing.replicate(docs, mixing.rates(docs), few=f).collect())
    assert few(True) == few(False) and mixing.mix(nothing).count() == 0


def test_decontamination_by_brute_force(spark, docs, nothing):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    items = [(10, item), (9, "short phrase here"), (8, None), (7, "!!!"), (6, item), (None, "short phrase here"), (5, "lorem ipsum dolor lorem ipsum")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = [(100, "x " + item.upper() + " y"), (101, "alpha beta gamma delta epsilon"), (102, "a short, phrase-here now"), (103, " ".join(["w"] * 500) + " short phrase here"), (104, item[: item.rfind(" ")])]
    all_docs = docs.unionByName(spark.createDataFrame(texts, "doc_id bigint, text string"), allowMissingColumns=True)
    low = lambda t: decontaminate_words(t)
    windows = {}
    for i, t in items:
        w = low(t)
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    want = []
    for d, t in [(r[0], r[1]) for r in ROWS] + texts:
        w, hit, found = low(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= own - {None}
        names = ",".join(sorted(map(str, found)))
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    out = decontaminate.contamination(all_docs, decontaminate.prefixes(all_docs, bench)).drop("__text")
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))
    clean = decontaminate.decontaminate(all_docs, bench)
    assert clean.columns == all_docs.columns and clean.count() == sum(not w[-1] for w in want)
    assert decontaminate.contamination(nothing, decontaminate.prefixes(nothing, bench)).count() == 0
    assert decontaminate.contamination(docs, decontaminate.prefixes(docs, bench.limit(0))).filter("contaminated or n_hit > 0").count() == 0


def decontaminate_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_decontamination_words_are_the_contracts_and_fast(spark):
    contract = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    points = spark.createDataFrame([(f"{chr(c)}x{chr(c)}",) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF], "text string")
    by_contract = words_of(ascii_lower(F.col("text")), contract)
    assert points.filter(decontaminate.words("text") != by_contract).count() == 0
    texts = spark.range(400).select(F.repeat(F.lit("Über die 12 Wörter, and the others; "), 1000).alias("text")).cache()

    def seconds(words):
        times = []
        for _ in range(4):
            start = time.perf_counter()
            texts.agg(F.sum(F.size(words))).collect()
            times.append(time.perf_counter() - start)
        return min(times)

    assert 2 * seconds(decontaminate.words("text")) < seconds(by_contract)
    texts.unpersist()


def test_decontamination_with_a_full_bitmap(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = decontaminate.prefixes(docs, bench)
    whole = sorted(map(str, decontaminate.contamination(docs, found).collect()))
    # 64 bits: nearly every shingle is a candidate.
    monkeypatch.setattr(decontaminate, "MIN_BITS", 6)
    assert sorted(map(str, decontaminate.contamination(docs, found, max_bits=6).collect())) == whole
    # Every word is counted instead of those of the benchmark.
    monkeypatch.setattr(decontaminate, "VOCABULARY", 0)
    assert sorted(map(str, decontaminate.contamination(docs, decontaminate.prefixes(docs, bench)).collect())) == whole


PAGES = [
    (1, "http://A.example/x", "<nav>menu</nav><p>one</p><div>same</div>"), (2, "http://a.example/y", "<p>two</p><div>same</div>"), (2, "http://a.example/y", "<p>two</p><div>same</div>"),
    (3, None, None), (4, "http://a.example/z", ""), (None, "nonsense", "<p>no key"), (5, "http://a.example/v", "<script>x()</script><!-- c --><p>three &amp; <b>four</b></p><div>same</div>"),
]


def test_line_dedup(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = {(r.page_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate_lines(df, ratio=0.5).collect()}
    assert got == {(1, "menu\none", 3, 1), (2, "two", 2, 1), (3, "", 0, 0), (4, "", 0, 0), (None, "no key", 1, 0), (5, "three &amp;\nfour", 3, 1)}
    assert {(r.page_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate_lines(df, ratio=0.5, share_rows=2).collect()} == got
    assert line_dedup.drop_boilerplate_lines(df.limit(0)).count() == 0
    mixed = [(i, "http://a/", f"<SCRIPT>x</SCRIPT>same\t\r\nown {i}<STYLE>y</style>" + "long " * 200_000) for i in range(6)]
    rows = line_dedup.drop_boilerplate_lines(spark.createDataFrame(mixed, "page_id bigint, url string, html string")).collect()
    assert {(r.text, r.n_dropped) for r in rows} == {(f"own {i}", 2) for i in range(6)}


def test_site_template(spark):
    rows = [(i, "http://h.example/p", f"<body><div>Shop of things</div><div><h2>Title {i}</h2><p>Body {i} &lt;x&gt;&nbsp; text</p></div><footer>f</footer></body>") for i in range(12)]
    df = spark.createDataFrame(rows + PAGES, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in site_template.extract(df, min_pages=5).collect() if r.url == "http://h.example/p")
    assert got == sorted((str(i), t := f"Title {i}\nBody {i} <x> text", len(t)) for i in range(12))
    assert site_template.extract(df.limit(0)).count() == 0
    page = '<article><header><h1>H</h1></header><p>a<br>b<p>c <b>d</b><div class="share">no</div><table><tr><td>1<td>2</table></article><div id="comments"><article class="comment">no</article></div><aside>s</aside>'
    assert site_template.main_text(page) == "H\na\nb\nc d\n1\n2"
    assert site_template.main_text("x < y <p>z<!-- open") == "x < y\nz" and site_template.main_text(None) == ""
    assert site_template.main_text("<div>" * 3000 + "deep") == "deep"


def test_site_template_in_articles(spark):
    notice = "<div>Prices may change</div><table><tr><td>open daily</table><ul><li>All<li>offers</ul><p>Written by the desk</p>"
    page = "<body><h2>Top of the site</h2><article><h1>Title {0}</h1>{1}<p>Body {0}</p>{2}<a>Share</a></article><p>Outside {0}</p></body>"
    half = lambda i: "<p>A passage of some</p>" if i < 8 else ""
    rows = [(i, "http://h.example/p", page.format(i, notice, half(i))) for i in range(12)]
    # An article with nothing but template is as good as none.
    rows += [(i, "http://k.example/p", f"<main><div>Loading</div></main><p>Own {i}</p>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {(r.url[7], r.page_id): r.text for r in site_template.extract(df, min_pages=5).collect()}
    want = {("h", i): f"Title {i}\nBody {i}" + ("\nA passage of some" if i < 8 else "") for i in range(12)}
    assert got == want | {("k", i): f"Own {i}" for i in range(12)}


def test_site_template_hashes_hold_whole_blocks():
    def inside(html):
        p = site_template.read_page(html)
        depth = lambda e: 0 if e < 0 else 1 + depth(p.up[e])
        return {t: depth(e) for t, e in zip(p.texts, p.within)}

    # A bold word is not the paragraph, even when its end tag is missing; a link that stands alone is its block.
    assert inside("<div>some <b>bold</b> words</div>") == inside("<div>some <b>bold words</div>") == {k: 1 for k in ["some bold words"]}
    assert inside("<div><a>link</a><p>text</p></div>") == {"link": 2, "text": 2}


def test_site_template_by_plain_counting(spark):
    rng = random.Random(4)
    parts = [f"<ul class='c{i}'><li><a>link {i}</a><li>more {i}</ul>" for i in range(6)] + [f"<p>sentence {i} of the house</p>" for i in range(6)]
    rows = []
    for i in range(120):
        host, often = f"h{i % 3}.example", [0.2, 0.6, 0.95]
        own = "".join(x for k, x in enumerate(parts) if rng.random() < often[k % 3])
        rows.append((i, f"http://{host}/{i}", f"<body>{own}<article><h1>T {i}</h1>{own}<p>body {i}</p></article><p>beside {i}</p></body>"))
    rows += rows[:4]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages = [(u.split("/")[2], site_template.read_page(h)) for _, u, h in rows]
    total, n = Counter(h for h, _ in pages), Counter((h, x) for h, p in pages for x in set(p.hashes))
    drop = {(h, x) for (h, x), c in n.items() if c >= 10 and c > (0.8 if x % 2 else 0.5) * total[h]}
    want = sorted((i, p.main_text({x for g, x in drop if g == h})) for (i, _, _), (h, p) in zip(rows, pages))
    assert len(drop) > 20
    for few, share in ((10**6, 10**6), (0, 10**6), (0, 7)):  # by broadcast, by host, and by shares of hosts
        assert sorted((r.page_id, r.text) for r in site_template.extract(df, broadcast_rows=few, share_rows=share).collect()) == want


def test_names_that_only_mention_a_sidebar_keep_their_text():
    for html in ('<div class="has-sidebar"><p>body</p></div>', '<div id="page" class="header-fixed"><p>body</p></div>', '<div class="elementor-widget-text-editor"><p>body</p></div>', '<article><div class="related-work"><p>body</p></div></article>'):
        assert site_template.main_text(html) == "body"
    for name in ("sidebar", "site-header", "ad-slot-3", "post-comments", "commentList", "cookie-consent", "menu-item-12", "side-bar"):
        assert site_template.main_text(f'<div class="{name}">no</div><p>yes</p>') == "yes"


def test_long_broken_pages_take_linear_time():
    import time

    began = time.time()
    for html in ("<a " * 350_000, '<a "' + '<b>"<c "' * 100_000, "<div>" * 200_000 + "deep", "<p>" * 200_000, "<b>" * 100_000 + "</p>" * 100_000, "<" * 1_000_000, "<div><b>x" * 50_000):
        site_template.main_text(html)
    assert time.time() - began < 20
    assert site_template.main_text("<p>" + "long words " * 300_000) == ("long words " * 300_000).strip()


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES + [(9, "u\n v", "<p>two</p><div>same</div>"), (8, "é", "Ünïcode 🙂" * 1000)], "page_id bigint, url string, html string").withColumn("kind", F.lit(1))
    keys = spark.createDataFrame([("None", "u", "a"), (" x\r\ny ", "u", "b"), (None, "u", "c"), (" x", "u", "b")], "page_id string, url string, html string")
    back = {(r.key, r.refers_to) for r in warc_zstd.read_pages(warc_zstd.write_pages(keys, warc_zstd.fresh_path(spark, "warc-keys"))).collect()}
    assert back == {("None", None), (" x", None), (" x\r\ny ", " x"), (None, None)}
    folder = warc_zstd.fresh_path(spark, "warc-test")
    got = sorted(tuple(map(str, r)) for r in warc_zstd.read_pages(warc_zstd.write_pages(df, folder)).collect())
    want = []
    first = {}
    rows = [(r.page_id, r.html or "") for r in df.collect()]
    for k, h in rows:
        if k is not None:
            first[h] = min(first.get(h, k), k)
    for k, h in rows:
        again = h in first and k != first[h] and sum(x == h for _, x in rows) > 1
        want.append(tuple(map(str, (k, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if again else "response", first[h] if again else None))))
    assert got == sorted(want)
    shared = sorted(tuple(map(str, r)) for r in warc_zstd.read_pages(warc_zstd.write_pages(df, warc_zstd.fresh_path(spark, "warc-shares"), share_rows=1)).collect())
    assert shared == got
    assert warc_zstd.read_pages(warc_zstd.write_pages(df.limit(0), warc_zstd.fresh_path(spark, "none"))).count() == 0


def test_warc_reader_checks():
    payload = b"<p>hello</p>" * 50
    records = [warc_zstd.make_record(str(i), "http://x/", payload + b"%d" % i, "response", warc_zstd.sha1_base32(payload + b"%d" % i), None) for i in range(40)]
    out = io.BytesIO()
    dictionary = warc_zstd.train_dictionary([r + bytes([i]) * 40 for i, r in enumerate(records)])
    warc_zstd.write_archive(out, records, dictionary)
    raw = out.getvalue()
    read = lambda b, chunk=7: [warc_zstd.page_of(*r)[0] for r in warc_zstd.ArchiveReader(io.BytesIO(b), chunk).records()]
    assert read(raw) == [str(i) for i in range(40)] == read(raw, 1 << 20)
    for broken in (raw[:-3], raw[:-30] + bytes([raw[-30] ^ 255]) + raw[-29:], b"junk" + raw):
        with pytest.raises(warc_zstd.WarcError):
            read(broken)
    for bad in (records[0].replace(b"WARC/1.1", b"HTTP/1.1", 1), records[0].replace(b"WARC-Date", b"Other"), records[0] + b"x", records[0].replace(b"hello", b"hallo", 1)):
        with pytest.raises(warc_zstd.WarcError):
            warc_zstd.page_of(*warc_zstd.parse_record(bad))


def test_pitman_yor_base_and_sums(spark, docs, nothing):
    got = pitman_yor.score(docs).collect()
    fold = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    train = Counter(w for k, t, *_ in ROWS if not fold(k) for w in tokens(t))
    n, v = sum(train.values()), len(train)
    want = sorted((len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(t)), 4), fold(k)) for k, t, *_ in ROWS)
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), r.held_out) for r in got) == want
    assert all(r.score < 0 for r in got) and pitman_yor.score(nothing).count() == 0


def test_pitman_yor_held_out_beats_the_base(spark):
    df = pitman_yor.score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).filter("held_out")
    r = df.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert pitman_yor.perplexity(r[0], r[2]) < pitman_yor.perplexity(r[1], r[2])


def by_customers(tokens, contexts, sweeps, burn_in, seed):
    """The model by its definition: every customer leaves and sits down again, one by one. tokens: (context word's value, word)."""
    rng = random.Random(seed)
    D, S = pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    masks = [(1 << b) - 1 for b in pitman_yor.BITS]
    seats = {}  # (level, restaurant, word): customers of each table
    total, distinct = Counter(), len({w for _, w in tokens})

    def p(level, at, w):
        if level < 0:
            return 1 / (distinct + 1)
        r = at & masks[level]
        own = seats.get((level, r, w), [])
        n, t = total[level, r, "c"], total[level, r, "t"]
        return (sum(own) - D[level] * len(own) + (S[level] + D[level] * t) * p(level - 1, at, w)) / (S[level] + n)

    def sit(level, at, w):
        if level < 0:
            return
        r = at & masks[level]
        own = seats.setdefault((level, r, w), [])
        opened = (S[level] + D[level] * total[level, r, "t"]) * p(level - 1, at, w)
        k = rng.choices(range(len(own) + 1), [x - D[level] for x in own] + [opened])[0]
        total[level, r, "c"] += 1
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            total[level, r, "t"] += 1
            sit(level - 1, at, w)

    def leave(level, at, w):
        if level < 0:
            return
        r = at & masks[level]
        own = seats[level, r, w]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        total[level, r, "c"] -= 1
        if not own[k]:
            own.pop(k)
            total[level, r, "t"] -= 1
            leave(level - 1, at, w)

    for at, w in tokens:
        sit(len(D) - 1, at, w)
    sums = Counter()
    for i in range(sweeps):
        for at, w in tokens:
            leave(len(D) - 1, at, w)
            sit(len(D) - 1, at, w)
        if i >= burn_in:
            for at, w in contexts:
                sums[at, w] += p(len(D) - 1, at, w)
    return {k: v / (sweeps - burn_in) for k, v in sums.items()}


def test_pitman_yor_by_single_customers(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(25)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(25)], k=40)) for _ in range(40)] + ["w0 w1 w2 w3 w4 w5"] * 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pitman_yor.score(df, samples=40).collect()}
    value = {w: int(pitman_yor.hashes_of([w.encode()])[0]) & (pitman_yor._CELLS - 1) for w in ["", *vocabulary]}
    pairs = lambda t: [(value[a], b) for a, b in zip(["", *t.split()], [*t.split(), ""])]
    train = [x for k, t in enumerate(texts) if not got[k].held_out for x in pairs(t)]
    p = by_customers(train, {x for t in texts for x in pairs(t)}, 60, 20, 1)
    for k, t in enumerate(texts):
        assert abs(got[k].score - sum(math.log10(p[x]) for x in pairs(t))) < 0.05 * got[k].n_tokens


def test_pitman_yor_reads_the_order_and_not_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    turned = docs.filter("doc_id < 20").select((F.col("doc_id") + 10**6).alias("doc_id"), F.array_join(F.array_sort(F.split("text", " ")), " ").alias("text"))
    both = docs.unionByName(turned)
    one = {r.doc_id: r.score for r in pitman_yor.score(both.coalesce(1)).collect()}
    # Other partitions, other blocks, other buckets: the same numbers to the last bit but for the order of a sum.
    other = {r.doc_id: r.score for r in pitman_yor.score(both.repartition(5), block_bytes=50_000).collect()}
    assert one.keys() == other.keys() and all(math.isclose(one[k], other[k], rel_tol=1e-12) for k in one)
    assert any(abs(one[k] - one[k + 10**6]) > 1 for k in range(20) if k in one)


def test_pitman_yor_tells_twins(spark):
    rng = random.Random(9)
    weights = [1 / (i + 3) for i in range(5000)]
    texts = [" ".join(f"w{i}" for i in rng.choices(range(5000), weights, k=120)) for _ in range(600)]
    texts += texts[:60]
    rows = [r for r in pitman_yor.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect() if not r.held_out]
    twice = {t for t in texts if sum(texts[r.doc_id] == t for r in rows) > 1}
    double, single = ([r.score for r in rows if (texts[r.doc_id] in twice) == x] for x in (True, False))
    assert len(double) > 60 and min(double) > sorted(single)[-len(single) // 100]


def test_predictions_of_a_restaurant_sum_to_one():
    rng = np.random.default_rng(8)
    few, last = 300, 1 << pitman_yor.BITS[-1]
    words = [b"w%d" % i for i in range(50)]
    word, context = np.divmod(np.arange(50 * few), few)
    counts = np.where(rng.random(50 * few) < 0.1, rng.integers(1, 60, 50 * few), 0)
    s = pitman_yor.Seating(pitman_yor.hashes_of(words), word, context, counts)
    for number in range(2):
        own = np.split(pitman_yor._sums(pitman_yor._kept(words, s)), np.cumsum([last, *(1 << b for b in pitman_yor.BITS)]))
        middle = 1 << pitman_yor.BITS[1]
        t = pitman_yor.Totals([np.array([own[2].sum()]), np.bincount(np.arange(last) % middle, own[3], middle), own[0]], own[1:4], 50)
        assert own[4][0] == (np.bincount(word, counts) > 0).sum()
        assert all((s.tables[k] <= s.customers[k]).all() and ((s.tables[k] > 0) == (s.customers[k] > 0)).all() for k in range(3))
        p = s.predictive(t)[-1].reshape(50, few).sum(axis=0)
        # What is left over is the unknown type's.
        rest = 1 / 51
        for k, at in ((0, np.zeros(few, int)), (1, np.arange(few) % middle), (2, np.arange(few))):
            rest = (1 + pitman_yor.DISCOUNT[k] * t.tables[k][at]) / (1 + t.customers[k][at]) * rest
        assert np.allclose(p + rest, 1)
        s.sweep(t, number, 1)


def test_tables_of_a_cell_are_drawn_whole():
    # Against the weights S(c, t) a^t by their recursion, below and beyond the tabled counts.
    rng = np.random.default_rng(4)
    for c, d, a in ((5, 0.6, 0.7), (300, 0.5, 3.0), (3000, 0.75, 0.4), (3000, 0.5, 20.0)):
        w = np.full(c + 2, -np.inf)
        w[1] = 0.0
        for n in range(1, c):
            t = np.arange(1, n + 2)
            w[1 : n + 2] = np.logaddexp(w[: n + 1], w[1 : n + 2] + np.log(np.maximum(n - d * t, 1e-300)))
        w[1:] += np.arange(1, c + 2) * np.log(a)
        p = np.exp(w - w.max())
        p /= p.sum()
        mean = (p * np.arange(c + 2)).sum()
        spread = math.sqrt((p * (np.arange(c + 2) - mean) ** 2).sum())
        got = pitman_yor.draw_tables(np.full(1000, c), np.full(1000, math.log(a)), d, rng.random(1000))
        assert abs(got.mean() - mean) < 5 * spread / math.sqrt(1000) and abs(got.std() / spread - 1) < 0.15
    # What a cell draws does not depend on the cells beside it.
    c, u = rng.integers(0, 3000, 500), rng.random(500)
    whole = pitman_yor.draw_tables(c, np.full(500, 0.3), 0.7, u)
    assert whole.tolist() == [int(pitman_yor.draw_tables(c[i : i + 1], np.full(1, 0.3), 0.7, u[i : i + 1])[0]) for i in range(500)]
