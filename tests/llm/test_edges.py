"""Edge cases, hot groups and brute-force comparisons that the other files leave out."""

import hashlib
import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomleaf.llm import covertree, langid, linetree, mainregion, mixing, nearcopies, queries, simhash, tiff, unigram, urltrie
from loomleaf.llm._common import materialise, small
from test_small import brute_fingerprint

SF = "/root/testdata/sf0.001"


# -- operator 1 --------------------------------------------------------------


def test_tiff_survives_any_bytes():
    rng = random.Random(21)
    pages = [(np.frombuffer(rng.randbytes(w * h), np.uint8).reshape(h, w), kind, tiled, p) for w, h, kind, tiled, p in ((8, 8, 1, False, 1), (64, 64, 5, True, 2), (12, 9, 8, False, 2), (16, 16, 32773, False, 1))]
    data = tiff.write_tiff(pages)
    for _ in range(10_000):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(bad)) if rng.random() < 0.5 else rng.randrange(max(1, len(bad) - 700), len(bad))
            bad[at] = rng.randrange(256)
        try:
            for _ in tiff.read_pages(bytes(bad), most=1 << 20):
                pass
        except tiff.TiffError:
            pass


@pytest.mark.parametrize(("kind", "raw"), [(2, b"64\0\0"), (11, struct.pack("<f", 64.0)), (12, struct.pack("<d", float("nan"))), (9, struct.pack("<i", -5)), (8, struct.pack("<hh", -1, 0))])
@pytest.mark.parametrize("tag", [256, 257, 273, 278, 279])
def test_tiff_sizes_of_odd_types(spark, tag, kind, raw):
    tags = [(256, 3, 1, struct.pack("<HH", 8, 0)), (257, 3, 1, struct.pack("<HH", 8, 0)), (258, 3, 1, struct.pack("<HH", 8, 0)), (273, 4, 1, struct.pack("<I", 8)), (278, 3, 1, struct.pack("<HH", 8, 0)), (279, 4, 1, struct.pack("<I", 64))]
    tags = [(t, kind, 1, raw) if t == tag else (t, k, n, v) for t, k, n, v in tags]
    body, extra, at = b"", b"", 8 + 64 + 2 + 12 * len(tags) + 4
    for t, k, n, v in tags:
        if len(v) > 4:
            v, extra = struct.pack("<I", at + len(extra)), extra + v
        body += struct.pack("<HHI", t, k, n) + v
    data = struct.pack("<2sHI", b"II", 42, 72) + b"p" * 64 + struct.pack("<H", len(tags)) + body + b"\0" * 4 + extra
    with pytest.raises(tiff.TiffError):
        list(tiff.read_pages(data))
    if tag == 256:
        (row,) = tiff.tiff_pages(spark.createDataFrame([(bytearray(data),)], "media binary")).collect()
        assert row["error"] and row["pixels"] is None


def test_tiff_query_columns(spark):
    """The stored form's size and hash, and the feature, against plain computations."""
    rows = {r["doc_id"]: r for r in queries.op1_tiff_pages(spark, SF).collect()}
    stored = {r["doc_id"]: bytes(r["media"]) for r in tiff.store_texts(spark.read.parquet(f"{SF}/documents.parquet"), keep=("doc_id",)).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        r, raw = rows[d["doc_id"]], d["text"].encode()
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[d["doc_id"]]), hashlib.sha256(stored[d["doc_id"]]).hexdigest())
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        mean = sum(padded) / len(padded)
        spread = (sum(b * b for b in padded) / len(padded) - mean * mean) ** 0.5
        edges = [int(i * len(padded) / 64) for i in range(65)]
        bits = [sum(padded[a:b]) / max(b - a, 1) > mean for a, b in zip(edges, edges[1:], strict=False)]
        assert r["feature"] == f"mean={mean:.4f};std={spread:.4f};ahash={int(''.join('01'[b] for b in bits), 2):016x}"


# -- operator 3 --------------------------------------------------------------


def test_lines_in_linear_time_and_by_share(spark):
    shared = "\n".join(f"this very line {i % 50} of a long text recurs" for i in range(100_000))
    own = lambda i: chr(97 + i % 26) * (3 + i // 26) + " alone"
    rows = [(i, f"{own(i)}\n{shared}" if i < 12 else own(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line_no", F.lit("mine"))
    began = time.time()
    got = {r["doc_id"]: r for r in linetree.drop_recurring_lines(df, counts=True).collect()}
    assert time.time() - began < 60 and got[0]["text"] == rows[0][1]
    assert all(got[i]["text"] == own(i) and got[i]["n_dropped"] == 100_000 and got[i]["line_no"] == "mine" for i in range(1, 12))
    few = spark.createDataFrame([(i, f"{own(i)}\nthe same short line here") for i in range(5)], "doc_id long, text string")
    assert linetree.drop_recurring_lines(few, counts=True).agg(F.sum("n_dropped")).first()[0] == 0
    assert linetree.drop_recurring_lines(few, counts=True, min_docs=0.5).agg(F.sum("n_dropped")).first()[0] == 4  # half of five texts are three
    assert linetree.drop_recurring_lines(few.limit(0)).count() == 0


# -- operator 4 --------------------------------------------------------------


def test_pages_empty_null_and_with_clashing_names(spark):
    pages = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "<p>x y</p>", "c"), (3, "<p>x y</p>", "c")], "page_id long, html string, text string")
    rows = mainregion.extract_main_text(pages, mainregion.learn_weights(pages), keep=("page_id", "text"))
    assert sorted((r["page_id"], r["text"], r["_text"]) for r in rows.collect()) == [(1, "a", ""), (2, "b", ""), (3, "c", "x y"), (3, "c", "x y")]
    assert mainregion.extract_main_text(pages.limit(0), mainregion.learn_weights(pages.limit(0))).count() == 0


# -- operator 6 --------------------------------------------------------------


def test_languages_of_long_texts_only(spark):
    rng = random.Random(3)
    words = {"aa": ["tarna", "vilo", "keste", "muor"], "bb": ["blick", "dross", "quarz", "zwolf"]}
    rows = [(f"{x} " * 2, x) for x in ()] + [(" ".join(rng.choice(words[x]) for _ in range(3000 if x == "aa" else 40)), x) for x in words for _ in range(6)]
    df = spark.createDataFrame(rows + [(None, "aa"), ("123 456", "cc"), ("text", None)], "text string, lang string").withColumn("rejected", F.lit("mine"))
    model = langid.learn_languages(df)
    assert set(model.languages) == {"aa", "bb"}
    got = langid.identify(df, model, keep=("text", "lang", "rejected")).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got if r["lang"] in words and r["text"]) and [r["score"] for r in got if not r["text"] or not any(map(str.isalpha, r["text"]))] == [0.0, 0.0]
    assert langid.learn_languages(df.limit(0)).languages == [] and langid.identify(df.limit(0), model).count() == 0
    assert langid.plain_letters("กินข้าว 12 हिन्दी-Été") == " กินข้าว हिन्दी été "


def test_more_languages_than_are_loaded_at_once(spark):
    rng = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{i:02d}" for i in range(23)]
    words = {n: ["".join(rng.choice(alphabet) for _ in range(6)) for _ in range(8)] for n in names}
    rows = [(n, " ".join(rng.choice(words[n]) for _ in range(60))) for n in names for _ in range(4)]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = langid.learn_languages(df)
    one = sorted(map(tuple, langid.identify(df, model, keep=("lang", "text")).collect()))
    assert one == sorted(map(tuple, langid.identify(df, model, keep=("lang", "text"), max_languages=5).collect()))
    assert sum(r[0] == r[2] for r in one) == len(one)
    known = model.compressors()
    for lang, text, said, score, rejected in one[:20]:  # by sizes computed anew
        data = f" {text} ".encode()
        sizes = [sum(len(c.compress(langid._MARK + data[at : at + model.piece])) for at in range(0, len(data), model.piece)) for c in known]
        first, second = sorted(sizes)[:2]
        assert said == model.languages[sizes.index(first)] and score == pytest.approx((second - first) / second) and rejected == (score < model.min_margin)


# -- operator 7 --------------------------------------------------------------


def test_url_join_equals_trie(spark):
    rng = random.Random(5)
    label = lambda: rng.choice(["com", "net", "a", "b", "É", "éx", "X", "x.y", ""])
    path = lambda: rng.choice(["", "/", "/en/", "/en/a", "/É", "/de/ß/"])
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((".".join(filter(None, (label(), label()))), path()) for _ in range(60))}.values())
    urls = [f"{rng.choice(['http', 'HTTPS', 'x'])}://{'.'.join(label() or 'z' for _ in range(rng.randint(1, 4)))}{path()}{rng.choice(['', 'tail', '?q', '#f'])}" for _ in range(300)] + [None, "", "no scheme", "://", "http://\nodd/x"]
    df = spark.createDataFrame([(i % 200, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit("mine"))
    trie = urltrie.judge_urls(df, rules, keep=("page_id", "url", "rule"))
    assert trie.columns == ["page_id", "url", "rule", "host", "path", "_rule", "verdict"]
    joined = urltrie.judge_urls_by_join(df, spark.createDataFrame(rules, "verdict string, host string, path string"))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, trie.select("page_id", "host", "path", "_rule", "verdict").collect())) == sorted(map(key, joined.collect()))
    assert urltrie.judge_urls(df.limit(0), rules).count() == 0


# -- operator 8 --------------------------------------------------------------


def test_top_k_prunes_and_counts(spark):
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres, n = unit(rng.normal(size=(60, 32))), 6000
    data = np.floor(256 * unit(centres[rng.integers(0, 60, n)] + 0.02 * rng.normal(size=(n, 32))))
    data[1000:3000] = data[7]  # a third of all rows in one place
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, vector array<double>").withColumn("score", F.lit("mine"))
    got: dict = {}
    rows = covertree.top_k(df, F.col("vec_id") % 50 == 0, k=5, pivot_rows=256, scored="scored").collect()
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    for q in range(0, n, 50):
        scores = data[q] @ data.T
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        assert sorted(got[q]) == [(k, *w) for k, w in enumerate(want, 1)]
    assert sum({r["query_id"]: r["scored"] for r in rows}.values()) < 0.6 * n * (n // 50)


def test_top_k_of_any_size(spark):
    df = spark.createDataFrame([(1, [1e30, 2.0]), (2, [3e30, 1.0]), (3, [-1e30, 0.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, [2.0]), (6, [2.0]), (7, None)], "vec_id long, vector array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"], r["score_text"]) for r in covertree.top_k(df, F.col("vec_id").isin(1, 5), k=3).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(1, 1, 2, None, str(int(1e30) * int(3e30) + 2)), (1, 2, 4, 0, "0"), (1, 3, 3, None, str(-int(1e30) ** 2))]
    assert got[3:] == [(5, 1, 6, 2, "2"), (5, 2, 6, 2, "2")]
    assert covertree.top_k(df.limit(0), F.lit(True)).count() == 0


# -- operator 9 --------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return queries.piece_model()


def best_sum(model, text):
    """The best sum over all ways to cut a text, unknown characters included, piece by piece."""
    scores = {p: float(s) for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True) if k == unigram.NORMAL}
    longest, best = max(map(len, scores)), [0.0] + [-1e18] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + longest) + 1):
            if text[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[text[i:j]])
        if text[i] not in scores:
            best[i + 1] = max(best[i + 1], best[i] + float(model.unknown_score))
    return best[-1]


def test_cutting_a_text_loses_nothing(spark, model):
    """Pieces of whole texts, found by segments, sum to the best over the uncut text; so do long segments."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(12).collect()] + ["x" * 300, "supercalifragilistic" * 20, "a  b\n漢字kana 12", "é" * 120]
    for text in texts:
        marked = unigram.MARK + text.replace(" ", unigram.MARK)
        ids = model.encode(text)
        assert ids == model._one(marked) or len(text) > 200
        spelled, total, at = 0, 0.0, 0
        for i in ids:
            if model.kinds[i] == unigram.NORMAL:
                total += float(model.scores[i])
            else:
                spelled += 1
        unknown = sum(c not in set(model.pieces) for c in marked)
        assert total + unknown * float(model.unknown_score) == pytest.approx(best_sum(model, marked), rel=1e-4, abs=1e-2)
        assert spelled == sum(len(c.encode()) for c in marked if c not in set(model.pieces)) and at == 0
        assert model.decode(ids) == text


def test_pieces_query(spark, model):
    rows = {r["doc_id"]: r for r in queries.op9_unigram_pieces(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        r = rows[d["doc_id"]]
        assert r["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest() and r["decoded_chars"] == len(d["text"]) and r["n_pieces"] == len(r["pieces"])
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "▁ x"), (3, "▁ x")], "pieces long, text string")
    got = unigram.encode_texts(odd, model, keep=("pieces",))
    assert got.columns == ["pieces", "_pieces", "n_pieces"] and sorted((r["pieces"], r["_pieces"] is None, r["n_pieces"]) for r in got.collect())[0] == (1, True, None)
    back = unigram.decode_pieces(got, model, pieces="_pieces", keep=("pieces",)).collect()
    assert sorted((r["pieces"], r["decoded"]) for r in back)[1:] == [(2, ""), (3, "▁ x"), (3, "▁ x")] and unigram.encode_texts(odd.limit(0), model).count() == 0


def test_models_that_normalise_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(f"{queries.TOKENIZERS}/{queries.PIECES}", "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="normalisation"):
        unigram.read_model(str(tmp_path / "m.model"))


# -- operator 10 and near copies -----------------------------------------------


def test_groups_with_clashing_names_and_none(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (None, "a b c d")], "doc_id long, text string").withColumn("fp", F.lit("mine")).withColumn("node", F.lit(0))
    prints = simhash.print_table(df)
    got = {(r["doc_id"], r["fp"] % (1 << 64)): r["component_id"] for r in simhash.near_components(prints).collect()}
    own = brute_fingerprint("a b c d")
    assert got == {(1, own): 1, (2, own): 1, (None, own): 1, (3, 0): 3, (4, 0): 3}
    assert simhash.near_components(simhash.print_table(df.limit(0))).count() == 0
    assert simhash.near_dedup(df).columns == df.columns and simhash.near_dedup(df).count() == 2


@pytest.mark.parametrize("crowd", [1, 4])
def test_large_groups_lose_no_link(spark, crowd):
    """Families, chains and strangers under shared keys: components equal those of all pairs."""
    rng = np.random.default_rng(8)
    sets = []
    for base in range(4):
        whole = rng.integers(0, 1 << 32, 100)
        for _ in range(12):  # a family: up to 12 of 100 changed
            own = whole.copy()
            own[rng.choice(100, rng.integers(0, 12), replace=False)] = rng.integers(0, 1 << 32)
            sets.append(own)
    chain = rng.integers(0, 1 << 32, 160)
    sets += [chain[i : i + 100] for i in range(0, 60, 9)] + [rng.integers(0, 1 << 32, 100) for _ in range(10)]
    sets = [np.unique(s.astype(np.uint32)) for s in sets]
    near = {(a, b) for a in range(len(sets)) for b in range(a) if nearcopies.jaccard(sets[a], sets[b]) >= 0.8}
    label = list(range(len(sets)))
    for a, b in near:
        label = [label[b] if x == label[a] else x for x in label]
    table = materialise(spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, hashes binary"))
    rows = [(k, i, len(s)) for i, s in enumerate(sets) for k in (1, 2 + i % 2)]
    none = materialise(spark.createDataFrame([], "a long, b long"))
    edges = nearcopies._within_groups(none, spark.createDataFrame(rows, "key long, node long, size long"), table, 0.8, first=crowd, growth=2)
    found = list(range(len(sets)))
    for a, b in edges.collect():
        found = [found[b] if x == found[a] else x for x in found]
    groups = lambda x: {frozenset(i for i, y in enumerate(x) if y == v) for v in x}
    assert groups(found) == groups(label)


def test_a_third_of_all_rows_near_copies_of_one_text(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(9000)}" for _ in range(150)]
    texts = []
    for i in range(300):
        own = list(base)
        own[rng.randrange(150)] = f"c{i}"
        texts.append(" ".join(own))
    texts += [" ".join(f"s{rng.randrange(9000)}" for _ in range(150)) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in nearcopies.drop_near_copies(df).collect()}
    assert kept == {0, *range(300, 900)}


# -- broadcasts and the pipeline ----------------------------------------------------


def test_broadcasts_are_bounded_by_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().logical().toString() or "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    rows = spark.createDataFrame([(i, list(range(1000))) for i in range(50)], "k long, line_nos array<int>")
    assert hinted(small(rows)) and not hinted(small(rows, most=100_000)) and not hinted(small(spark.createDataFrame([("x" * 1000,)], "t string"), most=900))


def test_pipeline_on_odd_tables(spark, tmp_path):
    rng = random.Random(10)
    words = {"en": ["house", "river", "stone", "light", "garden"], "de": ["wasser", "brücke", "schnee", "vogel", "tisch"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, text(x, 30 + i % 40), x, f"s{i % 3}") for i in range(120) for x in [("en", "de")[i % 2]]]
    rows += [(500, None, "en", "s0"), (501, "", "en", None), (502, "123 !!", None, "s1"), (503, rows[0][1], "en", None), (503, rows[0][1], "en", None), (None, text("en", 50), "en", "s2"), (504, text("de", 20_000), "de", "s1")]
    df = spark.createDataFrame([(i, t, x, s, None if t is None else len(t)) for i, t, x, s in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("node", F.lit("mine")).withColumn("size", F.lit(1))
    for name, table in (("full", df), ("empty", df.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, str(tmp_path / "full")))
        assert docs.columns == df.columns and docs.filter("n_chars <> length(text)").count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path / "full"))
    ids = Counter(r["doc_id"] for r in out.collect())
    assert not {500, 501, 502, 503} & set(ids) and ids[504] and set(ids) <= {r[0] for r in rows}
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_mix_of_nothing_and_of_one_source(spark):
    kind = "doc_id long, text string, source string"
    for rows in ([], [(1, None, None)], [(1, "", "a"), (2, "  ", "b")]):
        got = mixing.taken_words(spark.createDataFrame(rows, kind)).collect()
        assert len(got) == len(rows) and all(r["taken"] == 0 and r["target"] == 0 for r in got)
    (only,) = mixing.taken_words(spark.createDataFrame([(1, "w " * 1000, None)], kind)).collect()
    assert only["target"] == 1500 and abs(only["taken"] - 1500) <= 128 and zlib.crc32(b"") == 0
