"""Main-text extraction from raw pages with a linear-chain conditional random field.

A page is cut into its DOM leaf blocks (runs of text between block-level tags). Each block is described by its
ancestor tags, their class and id words, and by the text itself; a two-label chain (main text, other) is trained
by gradient ascent on the conditional likelihood of labelled pages and decoded by Viterbi. Labelled pages are a
set of layouts drawn in this module, which have regions of every kind with long and short text and hold a fixed share of the
likelihood, plus a bounded sample of the table (``TRAIN_PAGES``), labelled by their own markup: blocks inside ``article`` or
``main`` and outside navigation, asides, forms and the like. In half of the table's pages those two tags are hidden from the
features, so that the rest of the evidence is learned too; the regions around a block are not. A header inside the
article is the article's own, and so are figure captions.

Only the classifier sees a sample; extraction runs on every page, whole, one page per row inside an Arrow batch,
without a shuffle.

Defined cases: a null, empty or text-free page gives an empty text; repeated rows are extracted row by row; an
empty table gives an empty result; unclosed and crossing tags are tolerated; extra columns are kept.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound of the sample that the classifier is fitted on.
TRAIN_PAGES = 120

# The HTML standard's elements by role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle mspace mpadded mphantom merror menclose semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title svg iframe select".split())
MAIN = frozenset("article main".split())
#: Words of classes, ids and roles that name the container of the main text.
CONTAINER = MAIN | frozenset("post entry story content".split())
#: Regions of a page: their elements, and the words that name them in classes, ids and roles.
REGIONS = {
    "menu": ("nav menu", "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pager pagination"),
    "header": ("header", "header masthead topbar"),
    "footer": ("footer", "footer bottombar colophon contentinfo imprint copyright"),
    "sidebar": ("aside", "sidebar side aside complementary widget widgets rail"),
    "notice": ("dialog", "notice cookie cookies consent gdpr banner alert dialog modal popup overlay toast paywall"),
    "advert": ("", "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion"),
    "form": ("form button fieldset label input", "form subscribe newsletter signup login search searchbox"),
    "comments": ("", "comment comments reply replies respond discussion disqus"),
    "more": ("", "related share sharing social recommended recommendations teaser teasers"),
}
REGION_TAG = {tag: name for name, (tags, _) in REGIONS.items() for tag in tags.split()}
REGION_WORD = {word: name for name, (_, words) in REGIONS.items() for word in words.split()}

#: Attributes up to the tag's end. A quote opens a value only behind an equals sign and only if it is closed; nothing is
#: read twice.
ATTRIBUTES = r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+){ATTRIBUTES}|<[!?][^>]*>", re.DOTALL)
#: Raw elements that run to the end of the page when they are not closed; the tag's own slash does not close them.
SWALLOWS = frozenset("script style".split())
#: For each other raw element its tags, past comments, scripts and styles.
PAIRED = {
    tag: re.compile(rf"<!--.*?(?:-->|\Z)|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\b[^>]*>|\Z)|<(/?){tag}(?=[\s/>]){ATTRIBUTES}", re.DOTALL | re.IGNORECASE)
    for tag in RAW - SWALLOWS
}
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
SPACES = re.compile(r"\s+")


class Block(NamedTuple):
    """``text``; the open tags from the outside in, each with its class, id and role words; text inside links."""

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int


def raw_ends(page: str, tag: str) -> dict[int, int]:
    """For each closed element of a raw tag, where its opening tag starts and its closing tag ends. Elements that close
    themselves or are never closed are absent."""
    ends: dict[int, int] = {}
    opened: list[int] = []
    for m in PAIRED[tag].finditer(page):
        if m[2] is None:
            continue
        if not m[1]:
            if not m[2].endswith("/"):
                opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


def leaf_blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order; comments, scripts, styles and other raw elements hold none.

    A raw element that closes itself or has no closing tag holds nothing; only scripts and styles then run to the end.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[tuple[str, bool]] = []
    page = page or ""
    raw: dict[str, dict[int, int]] = {}

    def close() -> None:
        if parts:
            text = SPACES.sub(" ", "".join(x for x, _ in parts)).strip()
            if text:
                linked = sum(len(SPACES.sub(" ", x).strip()) for x, inside in parts if inside)
                blocks.append(Block(text, tuple(stack), linked))
            parts.clear()

    links, at, last = 0, 0, page.rfind(">") + 1  # no tag ends behind it, so none is sought there
    while True:
        m = TOKEN.search(page, at, last)
        data = page[at : m.start()] if m else page[at:].partition("<!--")[0]
        if data:
            parts.append((entities.unescape(data) if "&" in data else data, links > 0))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "br":
            parts.append((" ", False))
            continue
        if tag in RAW and not closing:
            if tag in SWALLOWS:
                end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            else:
                if tag not in raw:
                    raw[tag] = raw_ends(page, tag)
                at = raw[tag].get(m.start(), at)
            close()
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        close()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in VOID and not m[3].endswith("/"):
            if stack and stack[-1][0] == tag and tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                stack.pop()
            elif stack and stack[-1][0] == "p":
                stack.pop()
            words = tuple(w.lower() for a in ATTRIBUTE.finditer(m[3]) for w in re.findall(r"[A-Za-z]+", a[2] or a[3] or a[4] or ""))
            stack.append((tag, words))
    close()
    return blocks


def surroundings(path: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[set[str], set[str], bool]:
    """The regions inside the innermost container of main text, those around it, and whether there is such a container.

    A header inside a container is the text's own, not the page's; without a container all regions are inside.
    """
    inner, outer, container = set(), set(), False
    for tag, words in path:
        found = {REGION_TAG.get(tag), *map(REGION_WORD.get, words)} - {None}
        main = tag in MAIN or bool(CONTAINER & set(words))
        if "header" in found and (container or main):
            found = (found - {"header"}) | {"own"}
        if main and not found - {"own"}:
            outer, inner, container = outer | inner, set(), True
        inner |= found
    return inner, outer - inner, container


def features(block: Block, hidden: bool = False) -> list[str]:
    """Names of the block's binary features; ``hidden`` leaves out the tags that label training pages."""
    path = tuple(x for x in block.path if not (hidden and x[0] in MAIN))
    text = block.text
    inner, outer, container = surroundings(path)
    out = ["bias", f"leaf={path[-1][0] if path else 'none'}", f"depth={min(len(path), 8)}", f"container={container}", f"clear={not inner - {'own'}}"]
    out += [f"in={r}" for r in inner] + [f"around={r}" for r in outer]
    for tag, words in path:
        out.append(f"tag={tag}")
        out += [f"word={w}" for w in words if w not in REGION_WORD and w not in CONTAINER]
    n = len(text)
    out.append(f"length={min(n.bit_length(), 12)}")
    out.append(f"linked={min(4, 5 * block.linked // max(n, 1))}")
    out.append(f"sentence={text[-1:] in '.!?…' and n > 60}")
    out.append(f"commas={min(text.count(','), 3)}")
    low = text.lower()
    out += [f"says={w}" for w in ("©", "copyright", "cookie", "subscribe", "reply", "advert", "sign in", "privacy") if w in low]
    return out


def _sigmas(blocks: list[Block], weights: dict[str, np.ndarray], hidden: bool = False) -> np.ndarray:
    zero = np.zeros(2)
    return np.array([sum((weights.get(f, zero) for f in features(b, hidden)), zero) for b in blocks])


def viterbi(scores: np.ndarray, step: np.ndarray) -> list[int]:
    """The best label path of one page: ``scores`` by block and label, ``step`` by label pair."""
    best, back = scores[0], []
    for row in scores[1:]:
        through = best[:, None] + step
        back.append(through.argmax(0))
        best = through.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


class Model(NamedTuple):
    weights: dict[str, np.ndarray]
    step: np.ndarray

    def extract(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        if not blocks:
            return ""
        labels = viterbi(_sigmas(blocks, self.weights), self.step)
        return "\n\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def markup_labels(blocks: list[Block]) -> list[int]:
    """1 for blocks inside article or main, with no region of other matter inside or around it."""
    out = []
    for b in blocks:
        inner, outer, _ = surroundings(b.path)
        out.append(int(any(t in MAIN for t, _ in b.path) and not inner - {"own"} and not outer - {"form"}))
    return out


def train(pages: list[tuple[list[Block], list[int], bool]], rounds: int = 40, rate: float = 0.5, penalty: float = 1e-3, shares: list[float] | None = None) -> Model:
    """Gradient ascent (AdaGrad) on the chain's conditional log-likelihood, the sum of the pages' times their ``shares``."""
    index: dict[str, int] = {}
    coded = []
    shares = shares or [1 / max(1, len(pages))] * len(pages)
    for (blocks, labels, hidden), share in zip(pages, shares, strict=True):
        if blocks:
            coded.append((share, [np.array([index.setdefault(f, len(index)) for f in features(b, hidden)]) for b in blocks], np.array(labels)))
    w, step = np.zeros((max(len(index), 1), 2)), np.zeros((2, 2))
    seen_w, seen_s = np.full_like(w, 1e-6), np.full_like(step, 1e-6)
    for _ in range(rounds):
        grad_w, grad_s = -penalty * w, -penalty * step
        for share, rows, labels in coded:
            scores = np.array([w[r].sum(0) for r in rows])
            n = len(rows)
            forward, backward = np.empty((n, 2)), np.zeros((n, 2))
            forward[0] = scores[0]
            for i in range(1, n):
                forward[i] = np.logaddexp.reduce(forward[i - 1][:, None] + step, axis=0) + scores[i]
            for i in range(n - 2, -1, -1):
                backward[i] = np.logaddexp.reduce(step + (scores[i + 1] + backward[i + 1])[None, :], axis=1)
            total = np.logaddexp.reduce(forward[-1])
            marginal = np.exp(forward + backward - total)
            truth = np.eye(2)[labels]
            for r, d in zip(rows, truth - marginal, strict=True):
                np.add.at(grad_w, r, d * share)
            for i in range(1, n):
                pair = np.exp(forward[i - 1][:, None] + step + (scores[i] + backward[i])[None, :] - total)
                grad_s -= pair * share
                grad_s[labels[i - 1], labels[i]] += share
        seen_w += grad_w**2
        seen_s += grad_s**2
        w += rate * grad_w / np.sqrt(seen_w)
        step += rate * grad_s / np.sqrt(seen_s)
    return Model({f: w[i] for f, i in index.items()}, step)


#: Seed pages, and their share of the likelihood beside the table's pages.
SEEDS, SEED_SHARE = 110, 0.6
_SHORT = "Main one. Main item. Main words here".split(". ")
_LONG = (
    "Main text of the page that runs on for a while, with commas, and ends in a full stop.",
    "Main sentence about a cookie, a reply and the privacy of those who subscribe, which is long enough to be read as text.",
    "Main matter without an end that goes on and on over the line, and further",
)
_OTHER = (
    "See also",
    "Read this now",
    "Home",
    "All rights reserved.",
    "A sentence in a region that is no part of the text, though it is long, has commas, and ends in a full stop.",
    "I read all of this twice, and I do not agree with a word of it, but thank you for the time that you took over it!",
    "We use cookies, and so do our partners, to make this site better for you, as our privacy notice says.",
)


def _seeds(count: int = SEEDS) -> list[tuple[list[Block], list[int], bool]]:
    """Labelled layouts, drawn from a fixed seed: a container of main text, and regions of every kind before, in and behind it,
    each with long or short text in plain, paragraph, list or nested form. Blocks whose text starts with Main are main text."""
    draw = random.Random(9)

    def block(texts: tuple[str, ...], more: tuple[str, ...]) -> str:
        """Main text and regions are drawn from the same elements, so that those alone tell nothing."""
        kind = draw.choice("p p p p h2 h3 blockquote pre li td figcaption div".split())
        whole = {"li": "<ul><li>{}</li><li>{}</li></ul>", "td": "<table><tr><td>{}</td><td>{}</td></tr></table>", "figcaption": "<figure><figcaption>{}</figcaption></figure>"}
        return whole.get(kind, f"<{kind}>{{}}</{kind}>").format(draw.choice(texts), draw.choice(more))

    def region() -> str:
        name = draw.choice([*REGIONS, "comments", "sidebar", "advert"])
        tags, words = (x.split() for x in REGIONS[name])
        tag = draw.choice([*tags, "div", "section"]) if tags else draw.choice(["div", "section", "ul"])
        named = f" {draw.choice(['class', 'id'])}='{draw.choice(words)}{draw.choice(['', '-box', ' wide', '_1'])}'" if tag not in tags or draw.random() < 0.4 else ""
        inside = "".join(block(_OTHER, _OTHER) for _ in range(draw.randint(1, 3)))
        form = draw.randrange(6)
        if form == 0:
            inside = draw.choice(_OTHER)
        elif form == 1:
            inside = f"<ul><li><a href=#>{draw.choice(_OTHER)}</a></li><li>{draw.choice(_OTHER)}</li></ul>"
        elif form == 2:
            inside = f"<div class='{draw.choice(['content', 'inner', 'body'])}'>{inside}</div>"
        elif form == 3 and name in ("comments", "sidebar", "more"):
            inside = f"<article>{inside}</article>"
        return f"<{tag}{named}>{inside}</{tag}>"

    def main() -> str:
        return block((*_LONG, *_LONG, *_SHORT), _SHORT)

    def regions(least: int, most: int) -> str:
        return "".join(region() for _ in range(draw.randint(least, most)))

    out = []
    for k in range(count):
        body = "".join(main() + (regions(1, 1) if draw.random() < 0.35 else "") for _ in range(draw.randint(1, 6)))
        title = draw.choice(["<h1>Main heading</h1>", "<header><h1>Main heading</h1></header>", "<div class='entry-header'><h1>Main heading</h1></div>", ""])
        opening, closing = draw.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<article class='post'>", "</article>"), ("<div class='content'>", "</div>"), ("<div id='main'><div class='text'>", "</div></div>"), ("<section class='story wide'>", "</section>"), ("<div>", "</div>")])
        if "header" in title and opening == "<div>":
            title = "<h1>Main heading</h1>"
        page = f"{regions(0, 3)}{opening}{title}{body}{closing}{regions(0, 3)}"
        around = k % 11 == 0 and opening[1:5] in ("arti", "main")
        blocks = leaf_blocks(f"<form>{opening}{title}{body}{closing}</form>" if around else page)
        out.append((blocks, [int(b.text.startswith("Main")) for b in blocks], k % 3 == 2 and not around and "header" not in title))
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html: str = "html", sample: int = TRAIN_PAGES) -> Model:
    """Fit on the hand-labelled layouts and on at most ``sample`` pages that bear main-text markup.

    The sample is taken by hash, so reruns agree. Pages without ``article`` or ``main`` cannot label themselves.
    """
    marked = pages.where(F.col(html).rlike(r"(?i)<(article|main)\b"))
    share = min(1.0, 3 * sample / max(1, marked.count()))
    draw = F.xxhash64(F.col(id_col), F.lit(17))
    drawn = marked.where(F.pmod(draw, F.lit(1 << 20)) < share * (1 << 20))  # so that few rows compete for the limit
    rows = drawn.select(html).orderBy(draw, F.col(id_col)).limit(sample).toPandas()[html]
    labelled = _seeds()
    shares = [SEED_SHARE / len(labelled)] * len(labelled) + [(1 - SEED_SHARE) / max(1, len(rows))] * len(rows)
    for i, page in enumerate(rows):
        blocks = leaf_blocks(page)
        labelled.append((blocks, markup_labels(blocks), i % 2 == 1))
    return train(labelled, shares=shares)


def extract_main_text(pages: DataFrame, model: Model, html: str = "html", output: str = "text") -> DataFrame:
    """``pages`` without the markup column and with ``output``, the main text."""
    kept = [c for c in pages.columns if c not in (html, output)]
    shared = pages.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and the feature templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([shared.value.extract(x) for x in batch.column(batch.schema.get_field_index(html)).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], texts], [*kept, output])

    fields = {f.name: f for f in pages.schema.fields}
    picked = pages.select(*[F.col(f"`{c}`") for c in [*kept, html]])
    return picked.mapInArrow(run, T.StructType([*[fields[c] for c in kept], T.StructField(output, T.StringType())]))


def main_text_report(pages: DataFrame) -> DataFrame:
    """The contract's columns: page_id, url, text, n_chars."""
    pages = pages.select("page_id", "url", "html")
    return extract_main_text(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))
