"""The operators without Spark: codecs, trees, models."""

import random
import struct

import numpy as np
import pytest

from loomleaf.llm import covertree, langid, mainregion, simhash, tiff, unigram, urltrie


def test_tiff_codecs():
    rng = random.Random(1)
    for data in (b"", b"a", b"ab" * 9000, bytes(rng.randrange(256) for _ in range(20000)), b"\0" * 30000, bytes(rng.choice(b"abc ") for _ in range(70000))):
        assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    # The sample of the specification: 7 7 7 8 8 7 7 6 6 as codes of nine bits.
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == int(bits.ljust(88, "0"), 2).to_bytes(11, "big")


def test_tiff_pages_and_faults():
    rng = np.random.default_rng(2)
    pages = [(rng.integers(0, 256, (h, w), dtype=np.uint8), kind, tiled, p) for h, w, kind, tiled, p in ((5, 7, 1, False, 1), (130, 64, 5, True, 2), (300, 33, 8, False, 2), (64, 64, 32773, True, 1))]
    data = tiff.write_tiff(pages)
    back = list(tiff.read_pages(data))
    assert [p.pixels for p in back] == [s.tobytes() for s, *_ in pages]
    assert [p.layout for p in back] == ["strips", "tiles", "strips", "tiles"]
    for cut in range(0, len(data), 997):
        try:
            list(tiff.read_pages(data[:cut]))
        except tiff.TiffError:
            pass
    loop = bytearray(data)
    first = struct.unpack_from("<I", data, 4)[0]
    end = first + 2 + 12 * struct.unpack_from("<H", data, first)[0]
    struct.pack_into("<I", loop, end, first)
    with pytest.raises(tiff.TiffError):
        list(tiff.read_pages(bytes(loop)))
    with pytest.raises(tiff.TiffError):
        list(tiff.read_pages(data, most=10))


def test_tiff_big_endian_floats():
    values = np.linspace(-3, 9, 24, dtype=">f4").reshape(4, 6)
    rows = []
    for row in values:
        planes = np.frombuffer(row.tobytes(), np.uint8).reshape(6, 4).T.reshape(-1)
        rows.append(np.diff(planes, prepend=np.uint8(0)))
    strip = np.concatenate(rows).tobytes()
    tags = [(256, 3, 6), (257, 3, 4), (258, 3, 32), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 4), (279, 4, len(strip)), (317, 3, 3), (339, 3, 3)]
    body = struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags) + b"\0" * 4
    (page,) = tiff.read_pages(struct.pack(">2sHI", b"MM", 42, 8 + len(strip)) + strip + body)
    assert np.array_equal(np.frombuffer(page.pixels, "<f4"), values.astype("<f4").reshape(-1))


def brute_judge(url, rules):
    host, path = urltrie.split_url(url)
    fits = [(len(h) + len(p), h.count(".") + 1, h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[2], max(fits)[3]) if fits else (None, "allow")


def test_url_trie_against_all_rules():
    rng = random.Random(3)
    labels, segments = ["net", "org", "a", "b", "example"], ["en", "e", "", "x"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 3)))
    path = lambda: "".join("/" + rng.choice(segments) for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(60))}.values())
    trie = urltrie.UrlTrie(rules)
    for _ in range(3000):
        url = rng.choice(["http://", "https://", ""]) + host().upper() + path() + rng.choice(["", "?q", "#f", "tail"])
        assert trie.judge(*urltrie.split_url(url)) == brute_judge(url, rules), url
    assert urltrie.split_url(None) == ("", "") and urltrie.split_url("HTTP://A.B?x/y") == ("a.b", "")


def test_cover_tree_covers():
    x = np.random.default_rng(4).integers(-50, 50, (500, 8))
    x[100:200] = x[7]
    tree = covertree.CoverTree(x, leaf=8)
    assert sorted(tree.below(0)) == list(range(500))
    for n, c in enumerate(tree.centre):
        far = np.sqrt(((tree.x[tree.below(n)] - tree.x[c]) ** 2).sum(axis=1))
        assert far.max() <= tree.radius[n] + 1e-9


def test_cover_tree_prunes_clusters():
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(100, 32)))
    data = np.floor(256 * unit(centres[rng.integers(0, 100, 4000)] + 0.03 * rng.normal(size=(4000, 32)))).astype(np.int64)
    ids = np.arange(4000, dtype=np.int64)
    best = covertree.search(ids[::50], data[::50], ids, data, 5, tree_rows=1024)
    scores = data[::50] @ data.T
    scores[np.arange(80), ids[::50]] = -(1 << 40)
    for row in range(80):
        want = sorted(zip((-scores[row]).tolist(), range(4000), strict=True))[:5]
        assert [(-int(s), int(i)) for s, i in zip(best.score[row], best.id[row], strict=True)] == want
    assert best.scored.sum() < 0.35 * 80 * 4000
    floor = -np.sort(-scores, axis=1)[:, 4].astype(float)  # a known k-th score prunes more and loses nothing
    armed = covertree.search(ids[::50], data[::50], ids, data, 5, tree_rows=1024, floor=floor)
    assert (armed.score == best.score).all() and (armed.id == best.id).all() and armed.scored.sum() < best.scored.sum()


def test_bounds_hold():
    rng = np.random.default_rng(9)
    for _ in range(200):
        dim = int(rng.integers(1, 6))
        queries, points = (rng.normal(size=(20, dim)) * rng.lognormal(size=(20, 1)) + rng.normal(size=dim) * rng.choice([0, 1, 10]) for _ in range(2))
        qt, dt = (covertree.CoverTree(x, leaf=100) for x in (queries, points))
        dots = np.array([qt.x[0] @ dt.x[0]])
        far = covertree._angles(dots, qt.norm[0] * dt.norm[:1])
        bound = covertree.bounds(dots, qt.most[0], far, qt.radius[0], dt.norm[:1], dt.radius[0], dt.angle[0], qt.angle[0], dt.most[0])
        assert (queries @ points.T).max() <= bound[0] + 1e-6


@pytest.mark.parametrize("scale", [3, 200, 1 << 40])
def test_cover_tree_search_is_exact(scale):
    rng = np.random.default_rng(scale % 97)
    data = np.array([[int(v) for v in row] for row in rng.integers(-scale, scale, (700, 6))], dtype=np.int64)
    data[50:300] = data[9]
    ids = np.arange(700, dtype=np.int64)
    best = covertree.search(ids[::50], data[::50], ids, data, 5, tree_rows=128, leaf=8)
    for row, q in enumerate(range(0, 700, 50)):
        scores = sorted(((-sum(int(a) * int(b) for a, b in zip(data[q], data[i], strict=True)), i) for i in range(700) if i != q))[:5]
        assert [(-int(s), int(i)) for s, i in zip(best.score[row], best.id[row], strict=True)] == scores


def brute_fingerprint(text, words=3):
    import xxhash

    found = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    for text in ("", " \n", "One", "one two", "One TWO three", "É é E\x0bx\x1cy z z z z z", "a b " * 50, "ก ข ค ง"):
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == 0


@pytest.fixture(scope="module")
def model():
    return unigram.read_model("/opt/tokenizers/piece_bpe_32k.model")


def test_pieces_round_trip(model):
    for text in ("", " ", "  two  spaces ", "▁", "a▁b ▁", "line\nfeed\ttab\r\n", "漢字 😀 é́ ไทย", "x" * 5000, "\0zero", "<s></s><0x41><unk>", " "):
        assert model.decode(model.encode(text)) == text
    assert model.encode("") == []


def brute_score(model, text):
    scores = {p: float(s) for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True) if k == unigram.NORMAL}
    best = [0.0] + [-1e18] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 48) + 1):
            if text[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[text[i:j]])
        if text[i] not in scores:
            best[i + 1] = max(best[i + 1], best[i] + float(model.unknown_score))
    return best[-1]


def test_pieces_are_the_best(model):
    rng = random.Random(5)
    for _ in range(300):
        word = "▁" + "".join(rng.choice("theionrsaéñü,.#%0漢ก") for _ in range(rng.randint(1, 14)))
        (raw,) = model.encode_segments([word])
        ids = np.frombuffer(raw, np.int32).tolist()
        assert ids == model._one(word)
        unknown = sum(c not in model.pieces for c in word)
        total = sum(float(model.scores[i]) for i in ids if model.kinds[i] == unigram.NORMAL) + unknown * float(model.unknown_score)
        assert total == pytest.approx(brute_score(model, word), abs=1e-3)


def test_language_model():
    m = langid.LanguageModel(["en", "xx"], [b" the and of the and of " * 20, b" der die und der die und " * 20])
    known = m.compressors()
    assert m.judge("The and of the", known)[0] == "en" and m.judge("DIE und DER die und", known)[0] == "xx"
    for nothing in (None, "", "123 !?", "½"):
        assert m.judge(nothing, known) == ("und", 0.0, True)


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="</p>";</script></head><body><nav class="menu"><a href="/">Home</a></nav>
<div class="ad">Buy now</div><article><h1>Head &amp; more</h1><p><b>First   line<br>of&nbsp;it.<p>Second.</p><aside>aside words</aside><form>form</form><p>Third&lt;b&gt;.</p></article>
<section class="comments"><p>nice post really nice</p></section><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    weights = mainregion.RegionWeights()
    assert mainregion.main_text(PAGE, weights) == "Head & more\nFirst line of it.\nSecond.\nThird<b>."
    for nothing in (None, "", "<html></html>", "<script>x", "<nav>menu only</nav>", "<div", "<!-- open"):
        assert mainregion.main_text(nothing, weights) == ""
    assert mainregion.main_text("<p>" * 20000 + "x", weights) == "x"
    deep = "<div>" * 100_000 + "deep words here " * 100_000 + "</div>" * 100_000
    assert len(mainregion.main_text(deep, weights).split()) == 300_000


def test_nothing_else_is_dropped():
    weights, read = mainregion.RegionWeights(), lambda inner: mainregion.main_text(f"<article><p>one two three four</p>{inner}<p>last</p></article>", mainregion.RegionWeights()).split("\n")
    for inner, text in (("<h2 id='related-work'>Related work</h2>", "Related work"), ("<section id='discussion'><p>We discuss.</p></section>", "We discuss."), ("<svg-icon></svg-icon><p>After.</p>", "After."), ("<svg class='i'/><p>After.</p>", "After."), ("<p><math><mi>x</mi></math> is</p>", "x is"), ("<ul><li><a href=x>link</a></li></ul>", "link")):
        assert read(inner) == ["one two three four", text, "last"], inner
    for inner in ("<div class='ad'><p>buy " + "now " * 300 + "</p></div>", "<svg><text>drawn</text></svg>", "<aside>side</aside>", "<form>name <input></form>", "<div id='site-footer'>foot</div>", "<script>a < b</script>"):
        assert read(inner) == ["one two three four", "last"], inner
    assert mainregion.main_text("<p>outside</p><article><p>in</p></article><p>after the end</p>", weights) == "in"


def test_region_against_all_regions():
    rng = random.Random(11)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.1, -0.1, 0.0, 1.0, 2.0]) for _ in range(rng.randint(0, 14))]
        a, b = mainregion.best_region(scores)
        most = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        assert sum(scores[a:b]) == pytest.approx(most) and ((a, b) == (0, 0)) == (most <= 0)
