"""The operators on Spark: contracts, brute force, nulls, repeats, clashing names."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomleaf.llm import chat, covertree, linetree, mainregion, mixing, queries, simhash, tiff, unigram, urltrie
from oracle import both
from test_small import brute_fingerprint, brute_judge

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    ours, theirs = both(spark, SF, queries.QUERIES[name], queries.ORACLES[name])
    assert ours == theirs


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


EDGE = [(1, None, None, None), (2, "", "en", "a"), (3, "x", "en", "a"), (3, "x", "en", "a"), (None, "null id here", "en", None), (5, " \n\t ", None, "b"), (6, "word " * 30000, "en", "b"), (7, "ไทย 😀 ▁", "th", "c")]


def test_tiff_query(spark):
    rows = {r["doc_id"]: r for r in queries.op1_tiff_pages(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        raw, r = d["text"].encode(), rows[d["doc_id"]]
        padded = raw + b"\0" * (-len(raw) % 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert {r["compression"] for r in rows.values()} == {"deflate", "lzw", "packbits"}
    stored = tiff.store_texts(documents(spark, EDGE).withColumnRenamed("n_chars", "media"), keep=("doc_id", "media"))
    pages = tiff.tiff_pages(stored, media="_media", keep=("doc_id", "n_bytes")).collect()
    assert len(pages) == len(EDGE) and all(len(p["pixels"]) % 64 == 0 and p["error"] is None for p in pages)
    odd = tiff.tiff_pages(spark.createDataFrame([(1, None), (2, bytearray(b"II*")), (3, bytearray(b""))], "page int, media binary"), keep=("page",)).collect()
    assert [r["_page"] for r in odd] == [0, 0, 0] and all(r["error"] for r in odd)
    assert tiff.tiff_pages(stored.limit(0), media="_media").count() == 0


def test_chat_against_lists(spark):
    rng = random.Random(6)
    rows, convs = [], {}
    for c in range(120):
        turns = [("user" if i % 2 == 0 else "assistant", rng.choice("abc")) for i in range(rng.randint(1, 5))]
        convs[c] = turns
        rows += [(c, i + c % 3, r, x) for i, (r, x) in enumerate(turns)]
    rows += rows[:7]  # repeated rows
    rows += [(200, 250 + i, "user" if i % 2 else "assistant", f"t{i}") for i in range(20)] + [(201, None, "user", x) for x in "pq"]  # numbers across 256, and none
    convs[200], convs[201] = [("user" if i % 2 else "assistant", f"t{i}") for i in range(20)], [("user", "p"), ("user", "q")]
    # Rows without id are conversations of their own.
    convs["x"], convs["y"] = [(None, None)], [("user", "<|im_end|>")]
    rows += [(None, None, None, None), (None, 1, "user", "<|im_end|>"), (None, 1, "user", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    prefixes = {tuple(t[:k]) for t in convs.values() for k in range(1, len(t))}
    first = {}
    for c in [*sorted(c for c in convs if not isinstance(c, str)), "x", "y"]:
        first.setdefault(tuple(convs[c]), c)
    want = {c: t for t, c in first.items() if t not in prefixes}
    told = lambda turns: "".join(f"<|im_start|>{r or 'unknown'}\n{(x or '').replace('<|', '< |')}<|im_end|>\n" for r, x in turns)
    expected = sorted((str(None if isinstance(c, str) else c), len(t), sum(tuple(t) == tuple(o) for o in convs.values()), told(t)) for c, t in want.items())
    for run in (256, 2):
        got = sorted((str(r["conv_id"]), r["n_turns"], r["copies"], r["chat"]) for r in chat.render_chats(df.withColumn("s0", F.lit(1)), run_turns=run).collect())
        assert got == expected
    assert chat.render_chats(df.limit(0)).count() == 0


def test_chat_of_thousands_of_turns(spark):
    rows = [(1, i // 3, "user", f"{i:05d}") for i in range(6000)] + [(2, i // 3, "user", f"{i:05d}") for i in range(5999)] + [(3, 7, "user", "long " * 50_000)]
    got = {r["conv_id"]: r for r in chat.render_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert set(got) == {1, 3} and got[1]["n_turns"] == 6000
    assert got[1]["chat"] == "".join(f"<|im_start|>user\n{i:05d}<|im_end|>\n" for i in range(6000))


def test_lines(spark):
    base = [f"own line number{chr(97 + i)} of this very text" for i in range(14)]
    rows = [(i, f"{base[i]}\nPosted on the site by user{chr(97 + i)} at page one of today\nCall 555 {i} now please friends\n\nend{i}", "en", "a") for i in range(14)]
    rows += [(50 + i, rows[0][1], "en", "a") for i in range(30)] + EDGE  # copies of the first text
    df = documents(spark, rows).withColumn("t0", F.lit(1))
    out = linetree.drop_recurring_lines(df, counts=True)
    got = {(r["doc_id"], r["n_dropped"]): r["text"] for r in out.collect()}
    assert out.columns == [*df.columns, "n_lines", "n_dropped"] and out.count() == len(rows)
    for i in range(1, 14):
        assert got[i, 2] == f"{base[i]}\n\nend{i}"
    for i in (0, *range(50, 80)):
        assert got[i, 0] == rows[0][1]
    assert got[1, 2] and got[2, 0] == "" and (1, 0) in got and got[1, 0] is None


def test_main_region_without_article_tags(spark):
    """Weights learned from one half read the other half alike when nothing marks its articles."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = mainregion.learn_weights(pages.filter("page_id % 2 = 0"))
    rest = pages.filter("page_id % 2 = 1").withColumn("text", F.lit("mine"))
    bare = rest.withColumn("html", F.regexp_replace("html", "(</?)article", "$1div"))
    got = [{r["page_id"]: r["_text"] for r in mainregion.extract_main_text(p, weights, keep=("page_id", "text")).collect()} for p in (rest, bare)]
    assert got[0] == got[1] and all(got[0].values())
    plain = mainregion.RegionWeights()  # weights that say nothing leave menus and adverts in where no name tells
    assert mainregion.extract_main_text(rest.limit(0), plain, keep=("page_id",)).count() == 0


def test_weights_are_learned(spark):
    """Class names that no convention knows are boilerplate where labelled pages say so."""
    page = "<body><div class=zq>{0} links here</div><article><h1>T {0}</h1><p>body text number {0}</p></article><div class=xk>tail {0}</div></body>"
    pages = spark.createDataFrame([(i, page.format(i)) for i in range(60)], "page_id long, html string")
    weights = mainregion.learn_weights(pages)
    assert weights.word(".zq") < -1 and weights.tag("p") > weights.tag("body")
    bare = page.format(7).replace("article", "div")
    assert mainregion.main_text(bare, weights) == "T 7\nbody text number 7"
    assert mainregion.main_text(bare, mainregion.RegionWeights()) != "T 7\nbody text number 7"


def test_main_region(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = queries.op4_main_region(spark, SF).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in rows:
        inside = html[r["page_id"]].split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        want = "\n".join(b for b in (" ".join(__import__("html").unescape(__import__("re").sub("<br>", " ", __import__("re").sub("</?b>", "", x))).split()) for x in __import__("re").split("</?(?:p|h1)>", inside)) if b)
        assert r["text"] == want
    odd = spark.createDataFrame([(1, None), (1, None), (2, "")], "text int, html string")
    assert [r["_text"] for r in mainregion.extract_main_text(odd, mainregion.learn_weights(odd.withColumnRenamed("text", "page_id")), keep=("text",)).collect()] == ["", "", ""]


def fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * level > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in capped else w[s] * level for s in names}
        capped |= over


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(rng.choice([0, 1, 7, 300, 2500]))), "en", rng.choice(["a", "b", "c", "hot", "hot", "hot", None])) for i in range(400)] + EDGE
    df = documents(spark, rows).withColumn("size", F.lit("mine"))
    got = mixing.taken_words(df).collect()
    again = mixing.taken_words(df.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    targets, taken = fill(sizes), defaultdict(int)
    by_size = {round(v): k for k, v in sizes.items()}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(targets[s])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= max(256, 0.02 * targets[s]) for s in sizes)
    mixed = mixing.mixed_documents(df)
    words = defaultdict(int)
    for r in mixed.select("doc_id", "text", "n_chars").collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    for r in got:
        if r["doc_id"] not in (3, None):
            assert words[r["doc_id"]] == sum(g["taken"] for g in got if g["doc_id"] == r["doc_id"])
    twice = df.unionByName(df.limit(40))  # rows of equal id and text get draws of their own
    counted = {r["doc_id"]: r["n"] for r in mixing.taken_words(twice).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()}
    again = defaultdict(int)
    for r in mixing.mixed_documents(twice).select("doc_id", "text").collect():
        again[r["doc_id"]] += len(r["text"].split())
    assert all(again[d] == n for d, n in counted.items())
    assert mixed.columns == df.columns and mixing.taken_words(df.limit(0)).count() == 0


def test_mix_follows_the_draw(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    counts = {n: {r["doc_id"]: r["taken"] for r in mixing.taken_words(df, shards=n).collect()} for n in (3, 256)}
    assert counts[3] != counts[256]  # another draw takes other words
    blocks = mixing.packed_blocks(df, shards=3).collect()
    assert all(len(r["text"].split()) == r["n_words"] <= mixing.BLOCK_WORDS for r in blocks) and {r["shard"] for r in blocks} == {0, 1, 2}
    per = [sum(r["shard"] == s for r in blocks) for s in range(3)]
    assert per[0] == per[1] >= per[2]  # shards have a fixed length
    assert sum(r["n_words"] for r in blocks) == sum(counts[3].values())
    assert len({(r["source"], r["slot"]) for r in blocks}) == len(blocks) and len({r["place"] for r in blocks}) == len(blocks)
    once = {}
    for r in blocks:  # one permutation an epoch: no block twice
        once.setdefault((r["source"], r["epoch"]), []).append(r["block"])
    assert all(len(set(b)) == len(b) for b in once.values())
    assert mixing.packed_blocks(df.limit(0)).count() == 0


def test_draw_counts():
    import pandas as pd

    table = pd.DataFrame({"none": False, "src": ["a", "b", "c"], "source_size": [100_000, 1000, 0], "target": [50_000.0, 2000.0, 0.0], "blocks": [782, 8, 0], "slots": [1564, 16, 0]})
    shards = list(mixing.draw_counts(table, 8, 1 << 20, 128, 1))
    assert len(shards) == 8 and all((c >= 0).all() for _, _, c in shards)
    total = sum(c for _, _, c in shards)
    assert total[2] == 0 and total[1] <= 16 and abs(total[0] - 391) < 20
    assert len({tuple(c) for _, _, c in shards}) > 1  # chance, not a share
    assert len(list(mixing.draw_counts(table, 2, 16, 128, 1))) > 20  # a longer mix has more shards


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations(spark, n):
    rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1)).alias("p")).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))


def test_language(spark):
    rows = queries.op6_language(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_language_stage_edges(spark):
    rows = EDGE + [(100 + i, "the and of that with this for are was " * 5, "en", "a") for i in range(20)] + [(200 + i, "der die und das nicht mit ein ist auf " * 5, "de", "a") for i in range(20)]
    df = documents(spark, rows).withColumn("rejected", F.lit(0))
    out = corpus_pipeline.language(spark, df, SF)
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} >= set(range(100, 120)) | set(range(200, 220))
    assert corpus_pipeline.language(spark, df.limit(0), SF).count() == 0


def test_urls_by_join_are_the_same(spark):
    urls = [(1, None), (2, "nothing"), (3, "http://x.example.net/en/1"), (3, "http://x.example.net/en/1"), (4, "https://EXAMPLE.net/fr?en/"), (5, "http://net/"), (6, "http://a.org/fr/"), (7, "http://a.org/fr"), (8, "://b.example.com/de/#x"), (9, "http://notnet/")]
    df = spark.createDataFrame(urls, "page_id int, url string")
    one = urltrie.judge_urls(df, queries.URL_RULES, keep=("page_id",)).collect()
    rules = spark.createDataFrame(list(queries.URL_RULES), "verdict string, host string, path string")
    two = urltrie.judge_urls_by_join(df, rules).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))
    want = {i: brute_judge(u, queries.URL_RULES) for i, u in urls}
    assert all((r["rule"], r["verdict"]) == want[r["page_id"]] for r in one)
    with pytest.raises(ValueError):
        urltrie.judge_urls(df, queries.URL_RULES, max_rules=1)


def test_vectors_edges(spark):
    inf = float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (7, [3.0, 3.0]), (8, [3.0, 3.0]), (None, [9.0, 9.0]), (9, None), (10, [inf, 1.0]), (11, [float("nan"), 1.0]), (12, [None, 1.0]), (13, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").filter(covertree.usable("embedding"))
    got = covertree.top_k(df.withColumn("vector", F.transform("embedding", lambda x: F.floor(x).cast("bigint"))), F.col("vec_id") % 50 == 0, k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got if r["vec_id"] is not None) == [(0, 2, 7, 9), (0, 3, 8, 9), (50, 2, 7, 6), (50, 3, 8, 6)]
    assert [(r["query_id"], r["score"]) for r in got if r["rank"] == 1 and r["vec_id"] is None] in ([(0, 27), (50, 18)], [(50, 18), (0, 27)])
    assert covertree.top_k(df.limit(0).withColumn("vector", F.array(F.lit(1))), F.lit(True)).count() == 0


def test_pieces(spark):
    model = queries.piece_model()
    df = documents(spark, EDGE).withColumnRenamed("lang", "pieces")
    coded = unigram.encode_texts(df, model, keep=("doc_id", "pieces", "text"))
    back = unigram.decode_pieces(coded, model, "_pieces", keep=("text", "n_pieces")).collect()
    assert all(r["decoded"] == r["text"] for r in back) and len(back) == len(EDGE)
    assert {r["n_pieces"] for r in back if r["text"] is None} == {None}


def brute_components(prints):
    names = sorted(prints)
    parent = {n: n for n in names}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(names):
        for b in names[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in names}


@pytest.mark.parametrize("crowd", [8192, 4])
def test_components_of_fingerprints(spark, crowd):
    rng = random.Random(8)
    prints, n = {}, 0
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 25])):
            for _ in range(rng.randint(0, 3)):
                at ^= 1 << rng.randrange(64)
            prints[n], n = at, n + 1
    prints |= {n: prints[0], n + 1: 0, n + 2: 7, n + 3: (1 << 64) - 1}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, signed(p)) for i, p in prints.items()], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(df, crowd=crowd).collect()}
    assert got == brute_components(prints)


def test_dense_ball(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(62)
    prints = {i: centre ^ sum({1 << rng.randrange(62) for _ in range(rng.randint(0, 3))}) for i in range(600)}
    df = spark.createDataFrame(list(prints.items()), "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(df).collect()}
    assert got == brute_components(prints)


def test_simhash_query_and_dedup(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_simhash_groups(spark, SF).collect()
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(prints)
    df = documents(spark, EDGE).withColumn("fp", F.lit("mine")).withColumn("stays", F.lit(1))
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(["1", "3", "None", "6", "7"])
    assert simhash.near_dedup(df.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, seen = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
        seen.append(now.count())
    assert seen[1] >= 0.97 * seen[0] and seen[2] == seen[1] and seen[3] < seen[2]
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "pieces", "n_pieces"} <= set(out.columns) and out.count() > 0
