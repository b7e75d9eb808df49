"""Main text of web pages (operator 4) by a maximum-scoring subsequence of tokens.

A page is a sequence of words and tags.  Words score positive and tags negative,
by weights learned from labelled pages: pages that mark up their article label
themselves.  Both are log ratios of how often something stands inside against outside of
the articles:

* a tag weighs what its name does, never more than ``-TAG_COST``, so every tag lowers the
  sum, and tags of menus lower it more than those of paragraphs;
* an element weighs what its name, role and the parts of its class say about the words in
  it (of its id only if every part says the same kind of thing; headings name
  themselves, so theirs say nothing).  Where one weighs below -1 its words are boilerplate: they score
  nothing and are left out of the region, whose end only the tags can bring about; the tags
  of boilerplate in an article cost the least, so an advert there doesn't cut off what follows;
* a word scores the greatest weight above 1 that encloses it (its article's, say), else what
  words have that nothing speaks against; on a page with elements of such weights, words
  outside them score negative.

One linear scan finds the contiguous region of the highest sum.  Nothing asks for an
``article`` tag: a page that has none is read by the other weights.

Counts start from prior counts for what names say by convention ("nav",
"comment"), so a page unlike any labelled one is still read; labelled pages that disagree
outweigh them.

Text is made as a reader sees it: character references decoded, scripts, styles
and comments gone, white space inside a block made one space, blocks trimmed and
joined by one line feed in page order.

The sample that weights are learned from is bounded: the ``sample_pages`` labelled
pages of at most ``sample_chars`` characters with the smallest hashes of their ids.

Defined cases: null or empty html, or a page without a word that scores positive,
gives empty text; unclosed and stray tags are read as they come; any length and depth is
read in linear time; of regions with equal sums the first wins; repeated rows get equal
results; an empty table gives an empty one, and no labelled page leaves the prior counts;
columns kept may have any names (the new one is underscored until it clashes with none).
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, free_name, hash_bound, slices

SAMPLE_PAGES, SAMPLE_CHARS = 512, 65_536
#: What every tag costs, the most that a tag of menus and the like costs, what a word scores with nothing learned, and a limit of weights.
TAG_COST, TAG_MOST, WORD_SCORE, LIMIT = 0.1, 2.0, 1.0, 6.0
#: The feature of words that no element outside of the label speaks about.
PLAIN = ""
#: Weights below the first make boilerplate, above the second they mark content.
LEFT_OUT, MARKED = -1.0, 1.0

# Element names of the HTML standard by how they are read.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "title", "textarea", "select", "object")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that end when a sibling of theirs opens.
SIBLINGS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}}
SAY_NOTHING = frozenset("html body div span section table tbody thead tfoot tr td th a b i em strong u small p ul ol li dl dt dd br hr img h1 h2 h3 h4 h5 h6 pre code blockquote figure figcaption font center sup sub mark time picture source".split())
# What element names and parts of class, id and role say by convention.
BOILERPLATE = frozenset("nav navbar navigation menu menubar footer header masthead sidebar aside ad ads adv advert adverts advertisement sponsor sponsored promo banner notice cookie cookies consent newsletter subscribe signup login form search comment comments commentlist disqus related share sharing social breadcrumb breadcrumbs pagination pager toolbar widget copyright button dialog complementary contentinfo".split())
PLACES = frozenset("site main page section area wrapper container box block top bottom left right list global primary secondary bar".split())
CONTENT = frozenset("article main content story post entry articlebody maincontent".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg(?=[\s/>])(?:[^>\"'/]++|\"[^\"]*+\"|'[^']*+'|/(?!>))*+/>"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|<[a-z!?/][^>]*+\Z|(?P<text>[^<]++|<)",
    re.DOTALL | re.IGNORECASE,
)
_MARKS = re.compile(r"(?<![\w-])(?P<key>class|id|role)\s*+=\s*+(?:\"(?P<a>[^\"]*+)\"|'(?P<b>[^']*+)'|(?P<c>[^\s\"'>]++))", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def tokens(page: str):
    """("open" | "close", name, attributes) and ("text", text, "") in page order; raw elements and comments are skipped."""
    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            yield "text", m["text"], ""
        elif m["name"]:
            yield ("close" if m["end"] else "open"), m["name"].lower(), m["attrs"]


def features(name: str, attrs: str) -> tuple[str, ...]:
    """What an element says about the words in it."""
    if name in HEADINGS:
        return ()
    out = [] if name in SAY_NOTHING else [name]
    for m in _MARKS.finditer(attrs) if "=" in attrs else ():
        parts = [p.lower() for p in _PARTS.findall(m["a"] or m["b"] or m["c"] or "")]
        if m["key"].lower() != "id" or all(p in BOILERPLATE or p in PLACES for p in parts):
            out += ["." + p for p in parts]
    return tuple(out)


def prior(feature: str) -> tuple[float, float]:
    """Counts inside and outside the article to start from."""
    name = feature.lstrip(".")
    if feature == PLAIN:
        return math.exp(WORD_SCORE), 1.0
    if name in BOILERPLATE:
        return 0.5, 50.0
    return (50.0, 0.5) if name in CONTENT else (1.0, 1.0)


@dataclass
class RegionWeights:
    """Counted words by enclosing feature and tags by name, each inside and outside of articles."""

    words: dict = field(default_factory=dict)
    tags: dict = field(default_factory=dict)

    def __post_init__(self):
        self._word: dict[str, float] = {}
        self._tag: dict[str, float] = {}

    def word(self, feature: str) -> float:
        if feature not in self._word:
            (a, b), (c, d) = prior(feature), self.words.get(feature, (0, 0))
            self._word[feature] = max(-LIMIT, min(LIMIT, math.log((a + c) / (b + d))))
        return self._word[feature]

    def tag(self, name: str) -> float:
        """What a tag adds to the sum: always below zero."""
        if name not in self._tag:
            inside, outside = self.tags.get(name, (0, 0))
            if name in BOILERPLATE:
                outside += 10
            learned = math.log((inside + 1.0) / (outside + 1.0))
            least = -1.0 if name in SAY_NOTHING else -TAG_MOST
            self._tag[name] = max(least, min(0.0, learned)) - TAG_COST
        return self._tag[name]


class _Stack:
    """Open elements with the lowest weight down to each, and the greatest that marks content (0: none)."""

    def __init__(self, weigh):
        self.open, self.weigh, self.names = [("", 0.0, 0.0)], weigh, Counter()

    def _cut(self, at: int) -> None:
        self.names.subtract(x[0] for x in self.open[at:])
        del self.open[at:]

    def enter(self, name: str, attrs: str) -> None:
        while len(self.open) > 1 and name in SIBLINGS.get(self.open[-1][0], ()):
            self._cut(-1)
        if name in VOID:
            return
        _, least, marked = self.open[-1]
        told = features(name, attrs)
        if told:
            own = [self.weigh(f) for f in told]
            if name == "header" and marked:  # the heading of an article, not of the page
                own = own[1:]
            least = min([least, *own])
            marked = max([marked, *(w for w in own if w > MARKED)]) if least > LEFT_OUT else marked
        self.open.append((name, least, marked))
        self.names[name] += 1

    def leave(self, name: str) -> None:
        for at in range(len(self.open) - 1, 0, -1) if self.names[name] else ():
            if self.open[at][0] == name:
                self._cut(at)
                return
            if name not in BLOCKS and self.open[at][0] in BLOCKS:  # a stray inline end tag closes no block
                return


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of the highest positive sum, the first of equal ones; (0, 0) without any."""
    best, best_at, now, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if now <= 0:
            now, start = 0.0, i
        now += s
        if now > best:
            best, best_at = now, (start, i + 1)
    return best_at


def scored_tokens(page: str, weights: RegionWeights) -> tuple[list[float], list]:
    """For each token its score, and the words to show, a block edge (None) or nothing ("")."""
    stack, found, plain = _Stack(weights.word), [], max(weights.word(PLAIN), TAG_COST)
    for kind, what, attrs in tokens(page):
        if kind == "text":
            text = entities.unescape(what)
            _, least, marked = stack.open[-1]
            found.append((len(text.split()), text if least > LEFT_OUT else "", marked))
            continue
        _, least, marked = stack.open[-1]
        if kind == "open":
            stack.enter(what, attrs)
        else:
            stack.leave(what)
        # Inside of content, what is left out has been judged by its element already.
        cheap = marked and min(least, stack.open[-1][1]) <= LEFT_OUT
        found.append((-TAG_COST if cheap else weights.tag(what), None if what in BLOCKS else " " if what == "br" else "", None))
    outside = -WORD_SCORE if any(marked for _, _, marked in found) else plain
    score = lambda n, shown, marked: n if marked is None else 0.0 if not shown else n * (marked or outside)
    return [score(*f) for f in found], [f[1] for f in found]


def main_text(page: str | None, weights: RegionWeights) -> str:
    """The main text of one page."""
    if not page:
        return ""
    scores, shown = scored_tokens(page, weights)
    blocks: list[str] = []
    parts: list[str] = []
    for piece in [*shown[slice(*best_region(scores))], None]:
        if piece is not None:
            parts.append(piece)
        elif parts:
            if block := " ".join("".join(parts).split()):
                blocks.append(block)
            parts = []
    return "\n".join(blocks)


def learn_page(page: str, words: Counter, tags: Counter) -> None:
    """Count the words and tags of one page that marks up its article."""
    stack, depth = _Stack(lambda f: 0.0), 0
    held: list[tuple[tuple[str, ...], bool]] = [((), False)]
    for kind, what, attrs in tokens(page):
        if kind == "text":
            n = len(what.split())
            told = set().union(*(f for f, _ in held))
            for f in told or () if any(f for f, label in held if not label) else {*told, PLAIN}:
                words[f, depth > 0] += n
            continue
        if kind == "open":
            stack.enter(what, attrs)
            del held[len(stack.open) - 1 :]
            held += [(features(what, attrs), what == "article")] * (len(stack.open) - len(held))
            depth += what == "article"
            tags[what, depth > 0] += 1
        else:
            stack.leave(what)
            del held[len(stack.open) :]
            tags[what, depth > 0] += 1
            depth -= what == "article" and depth > 0


def learn_weights(pages: DataFrame, html: str = "html", page_id: str = "page_id", sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> RegionWeights:
    """Weights from the labelled pages of the bounded sample; without any, the priors alone."""
    labelled = pages.select(F.col(page_id).alias("id"), F.col(html).alias("html")).filter(F.col("html").contains("<article") & (F.length("html") <= sample_chars))
    order = F.xxhash64("id", "html")
    # Few more rows than are asked for reach the sort: those with the lowest hashes, of ever more if labels are rare.
    share = 4 * sample_pages / max(1, pages.count())
    while True:
        near = labelled.filter(order <= hash_bound(share)) if share < 1 else labelled
        sample = [r["html"] for r in near.orderBy(order, "id").limit(sample_pages).select("html").collect()]
        if share >= 1 or 8 * len(sample) >= sample_pages:
            break
        share *= 16
    words: Counter = Counter()
    tags: Counter = Counter()
    for page in sample:
        learn_page(page, words, tags)
    pair = lambda counts: {f: (counts[f, True], counts[f, False]) for f, _ in counts}
    return RegionWeights(pair(words), pair(tags))


def extract_main_text(df: DataFrame, weights: RegionWeights, html: str = "html", keep: tuple = (), name: str = "text") -> DataFrame:
    """``keep`` columns with the main text of each page."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    inner = free_name(keep, "page_html")
    bounded_batches(df.sparkSession)
    source = df.select(*keep, F.col(html).cast("string").alias(inner))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(free_name(keep, name), T.StringType())])

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(x.as_py(), shared.value) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
