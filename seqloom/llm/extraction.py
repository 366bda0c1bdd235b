"""Main text of web pages: flat blocks, their densities and surroundings, and a decision tree."""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, quoted, read

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^>]*)(?:>|\Z))",
    re.S,
)
HINTS = re.compile(r"(?i)(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
UNSEEN = re.compile(r"(?i)(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Elements and the words in class, id and role that tell what an element is for (fixed values).
SKIPPED = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html label legend li main menu nav noscript ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("button label legend option optgroup select noscript template svg".split())
FRAME = frozenset("nav aside footer header form dialog menu search".split())
CONTENT = frozenset("article main content post entry story body text prose".split())
BOILER = frozenset(
    "nav navigation navbar menu header footer contentinfo sidebar aside complementary ad ads advert advertisement adsense banner promo sponsor sponsored cookie cookies consent gdpr "
    "notice alert warning popup modal dialog overlay newsletter subscribe subscription signup login register search form share sharing social related recommended recommendations "
    "breadcrumb breadcrumbs pagination pager widget toolbar copyright legal disclaimer masthead topbar skip hidden rail teaser".split()
)
COMMENTS = frozenset("comment comments reply replies discussion disqus respond responses reader readers".split())
#: What closes when an element of the same kind starts, unless one of the second group was opened since.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"table", "tr"})),
    "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "inside", "comment", "heading", "control", "sentence", "marked_page")


class Context:
    """Open elements, and what the nearest of them that says so is for: 1 content, -1 a frame around it, 0 unknown."""

    def __init__(self):
        self.stack: list[tuple[str, int, int, int, int]] = []  # tag, place, inside content, inside comments, inside controls
        self.open: Counter = Counter()

    def top(self) -> tuple[str, int, int, int, int]:
        return self.stack[-1] if self.stack else ("", 0, 0, 0, 0)

    def start(self, tag: str, attributes: str) -> None:
        if self.top()[0] == "p":
            self._pop()
        same, barrier = CLOSES.get(tag, ((), ()))
        if any(self.open[t] for t in same):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in barrier:
                    break
                if self.stack[i][0] in same:
                    self._cut(i)
                    break
        _, place, inside, comment, control = self.top()
        words = {w.lower() for found in HINTS.findall(attributes) for w in WORDS.findall(" ".join(found))} if attributes else set()
        if words & COMMENTS:
            place, comment = -1, 1
        elif tag in FRAME or words & BOILER or attributes and UNSEEN.search(attributes):
            place = -1
        elif (tag in ("article", "main") or words & CONTENT) and not comment and tag not in ("body", "html"):
            place, inside = 1, 1
        self.stack.append((tag, place, inside, comment, control or tag in CONTROLS))
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        if self.open[tag]:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    self._cut(i)
                    break

    def _cut(self, to: int) -> None:
        while len(self.stack) > to:
            self._pop()

    def _pop(self) -> None:
        self.open[self.stack.pop()[0]] -= 1


def blocks(page: str) -> list[tuple[str, int, tuple[int, ...], bool]]:
    """Flat text blocks of a page, in order: text, words in links, (place, inside, comment, heading, control), and whether a labeller marked it.

    A block ends where an element of block level starts or ends; references are
    decoded and white space is one space. Comments, declarations and the
    insides of scripts, styles, titles and the like are no text.
    """
    out: list = []
    context, held, linked, in_link, heading, marked = Context(), [], 0, 0, 0, False
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                _, place, inside, comment, control = context.top()
                out.append((text, linked, (place, inside, comment, int(heading > 0), int(control)), marked))
            held.clear()
        linked = 0

    while at < size:
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else size]
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            held.append(piece)
            if in_link:
                linked += len(piece.split())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3] or m[4] or ""
        if m[1]:
            if tag in BLOCKS:
                flush()
                context.end(tag)
                heading -= tag in HEADINGS and heading > 0
                in_link = 0 if tag != "a" else in_link
            elif tag == "a":
                in_link = 0
            elif tag == "br":
                held.append(" ")
        elif tag in SKIPPED:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else size
        elif tag in BLOCKS:
            flush()
            if tag != "hr":
                context.start(tag, attributes)
                heading += tag in HEADINGS
                marked = "data-main" in attributes if attributes else False
        elif tag == "a":
            in_link = 1
        elif tag in ("br", "img", "input", "wbr"):
            held.append(" " if tag != "wbr" else "")
    flush()
    return out


def features(found: list) -> np.ndarray:
    """FEATURES of each block of a page: its words and link density, those of its neighbours, and where it stands."""
    words = np.array([len(text.split()) for text, *_ in found], float)
    links = np.array([linked for _, linked, *_ in found]) / np.maximum(words, 1)
    placed = np.array([place for _, _, place, _ in found], float)
    around = [np.concatenate([[0.0], x[:-1]]) for x in (words, links)] + [np.concatenate([x[1:], [0.0]]) for x in (words, links)]
    sentence = np.array([text[-1] in ".!?…:;。！？\"”»)" for text, *_ in found], float)
    marked_page = np.full(len(found), float((placed[:, 0] > 0).any()))
    return np.column_stack([words, links, *around, *placed.T, sentence, marked_page])


class Tree:
    """A binary decision tree by Gini impurity over numeric features; leaves hold the share of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, leaf: int = 2):
        self.nodes: list[tuple[int, float, int, int, float]] = []  # feature, cut, left, right, share
        self._grow(x, y.astype(float), depth, leaf)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, leaf: int) -> int:
        node, n = len(self.nodes), len(y)
        self.nodes.append((-1, 0.0, -1, -1, float(y.mean()) if n else 0.0))
        best = (1e-9, -1, 0.0)
        if depth and n >= 2 * leaf and 0 < y.sum() < n:
            whole = n * y.mean() * (1 - y.mean())
            for j in range(x.shape[1]):
                order = np.argsort(x[:, j], kind="stable")
                v, s = x[order, j], np.cumsum(y[order])[:-1]
                left = np.arange(1, n)
                right = n - left
                gain = whole - s * (1 - s / left) - (s[-1] + y[order[-1]] - s) * (1 - (s[-1] + y[order[-1]] - s) / right)
                gain[(v[1:] == v[:-1]) | (left < leaf) | (right < leaf)] = -1
                i = int(np.argmax(gain))
                if gain[i] > best[0] + 1e-12:
                    best = (float(gain[i]), j, float(v[i] + v[i + 1]) / 2)
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            left = self._grow(x[low], y[low], depth - 1, leaf)
            right = self._grow(x[~low], y[~low], depth - 1, leaf)
            self.nodes[node] = (best[1], best[2], left, right, self.nodes[node][4])
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Shares of label 1, for all rows at once."""
        feature, cut, left, right, share = (np.array(c) for c in zip(*self.nodes))
        at = np.zeros(len(x), int)
        while (live := feature[at] >= 0).any():
            rows = np.nonzero(live)[0]
            node = at[rows]
            low = x[rows, feature[node]] <= cut[node]
            at[rows] = np.where(low, left[node], right[node])
        return share[at]


def labelled_pages(count: int = 400, seed: int = 5) -> list[str]:
    """A small labelled table: pages made by rule in five layouts, blocks of the main text marked ``data-main``.

    Layouts: elements that say what they are; the same by class names only;
    nested content wrappers; pages without any hint, where density and
    neighbours must do; and a body inside one form. Frames hold short and long
    texts, with and without links, comments read like articles.
    """
    rng = random.Random(seed)

    def text(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("aeiounrstl") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(low, high)))

    sentence = lambda low, high: text(low, high).capitalize() + rng.choice("...?!")
    links = lambda n: "".join(f'<li><a href="#">{text(1, 3)}</a></li>' for _ in range(n))
    spot = lambda names: rng.choice(names.split())

    def body(mark: bool = True) -> str:
        m = " data-main" if mark else ""
        parts = [f"<h1{m}>{text(2, 12)}</h1>"] if rng.random() < 0.6 else []
        for _ in range(rng.randint(1, 8)):
            kind = rng.random()
            if kind < 0.1:
                parts.append(f"<h2{m}>{text(1, 6)}</h2>")
            elif kind < 0.2:
                parts.append("<ul>" + "".join(f"<li{m}>{sentence(1, 12)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif kind < 0.3:
                parts.append(f"<p{m}><a href='#'>{text(1, 8)}</a></p><p{m}>{text(1, 30)}</p><blockquote{m}>{text(1, 9)}</blockquote>")
            elif kind < 0.4:
                parts.append(f"<p{m}>{sentence(4, 20)} <a href='#'>{text(1, 3)}</a> {sentence(4, 20)}</p>")
            else:
                parts.append(f"<p{m}>{sentence(1, 6) if rng.random() < 0.3 else sentence(10, 80)}</p>")
        return "".join(parts)

    def frames(tag) -> tuple[str, str]:
        """What stands before and after the article; ``tag`` opens and closes an element for a purpose."""
        before = [tag("nav", f"<ul>{links(rng.randint(3, 8))}</ul>"), tag("header", f"<p>{text(1, 4)}</p><p>{sentence(3, 12)}</p>"), tag(spot("ad banner advert sponsored"), sentence(3, 90))]
        after = [
            tag("footer", f"<p>© {text(1, 5)}</p><p>{sentence(5, 30)}</p>"),
            tag(spot("sidebar aside related widget"), f"<h3>{text(1, 3)}</h3><p>{sentence(5, 90)}</p><ul>{links(3)}</ul>"),
            tag(spot("cookie-notice notice alert newsletter"), f"<p>{sentence(8, 90)}</p>"),
            tag("form", f"<label>{text(1, 3)}</label><button>{text(1, 2)}</button><p>{sentence(3, 15)}</p>"),
            tag(spot("comments discussion"), "".join(f'<div class="{spot("comment reply item")}"><h4>{text(1, 2)}</h4><p>{sentence(5, 90)}</p></div>' for _ in range(rng.randint(1, 3)))),
        ]
        rng.shuffle(before)
        rng.shuffle(after)
        return "".join(before[: rng.randint(1, 3)]), "".join(after[: rng.randint(1, 5)])

    def semantic(name: str, inner: str) -> str:
        element = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(name)
        other = spot("div section")
        return f"<{element}>{inner}</{element}>" if element else f'<{other} class="{name}">{inner}</{other}>'

    classed = lambda name, inner: f'<div {spot("class id")}="{rng.choice(("site-", "page-", "box ", ""))}{name}">{inner}</div>'
    pages = []
    for i in range(count):
        layout = i % 5
        tag = semantic if layout in (0, 2) else classed
        before, after = frames(tag)
        if rng.random() < 0.4:  # a frame that doesn't say so, on a page whose article does
            before, after = before + f"<div>{sentence(2, 60)}</div>", after + f"<p>{sentence(2, 60)}</p>"
        inner = body()
        if rng.random() < 0.4:  # frames inside the article
            inner += tag(spot("share related ad comments"), f"<p>{sentence(3, 30)}</p>")
        if rng.random() < 0.3:
            inner = f"<header><h1 data-main>{text(2, 9)}</h1><p>{text(2, 6)}</p></header>" + inner
        if layout == 0:
            page = f"{before}<article>{inner}</article>{after}"
        elif layout == 1:
            page = f'{before}<div class="{spot("article content post-body entry story")}">{inner}</div>{after}'
        elif layout == 2:
            page = f'<div class="wrapper has-sidebar">{before}<main><div class="content"><article>{inner}</article></div></main>{after}</div>'
        elif layout == 3:  # no hints
            lone = "".join(f"<p data-main>{sentence(25, 90)}</p>" for _ in range(rng.randint(2, 6)))
            page = f"<div><ul>{links(rng.randint(4, 9))}</ul></div><h1 data-main>{text(3, 10)}</h1>{lone}<div>© {text(1, 4)}</div><div><ul>{links(3)}</ul></div>"
        else:
            page = f'<form action="#"><div class="top">{before}</div><div id="main">{inner}</div>{after}</form>'
        pages.append(f"<!DOCTYPE html><html><head><title>{text(2, 6)}</title></head><body>{page}</body></html>")
    return pages


@lru_cache(maxsize=4)
def trained(pages: tuple[str, ...] | None = None) -> Tree:
    """The tree of a labelled table: pages whose main blocks bear the attribute ``data-main``."""
    found = [b for b in map(blocks, labelled_pages() if pages is None else pages) if b]
    return Tree(np.concatenate([features(b) for b in found]), np.array([marked for b in found for *_, marked in b]))


def main_text(page: str | None, tree: Tree) -> str:
    """Blocks that the tree takes for main text, joined by line breaks; empty if none."""
    found = blocks(page) if page else []
    if not found:
        return ""
    kept = tree.predict(features(found)) >= 0.5
    return "\n".join(text for (text, *_), k in zip(found, kept) if k)


def extract_text(pages: DataFrame, html: str = "html", keep: Iterable[str] | None = None, labelled: Iterable[str] | None = None) -> DataFrame:
    """The main text of every whole page.

    A page becomes a flat list of text blocks; each has its words and link
    density, those of the blocks before and after it, and what the elements
    around it say they are for. A decision tree, trained on ``labelled`` pages
    (main blocks bear ``data-main``; by default 400 pages made by rule), tells
    main text from menus, headers, footers, sidebars, notices, adverts, forms
    and comments. Rows are independent of each other and nothing is shuffled.

    Returns ``keep`` (all input columns by default), text and n_chars, which
    replace input columns of these names. A null or empty page, and one without
    main text, has an empty text; unclosed elements, quotes and comments end
    with the page. Repeated rows have the same result; an empty table gives an
    empty result.
    """
    own = carried(pages, keep, ("text", "n_chars"))
    tree = trained(None if labelled is None else tuple(labelled))
    rows = pages.select(*[quoted(c) for c in own], quoted(html).alias("page_html_"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, tree) for page in batch.column(len(own)).to_pylist()]
            columns = [*batch.columns[: len(own)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, "text", "n_chars"])

    schema = rows.select(*[quoted(c) for c in own], F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return rows.mapInArrow(extract, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"), keep=["page_id", "url"])


#: The given pages have one layout: all main text, and nothing else, is in one article of headings and paragraphs.
SQL = r"""
WITH a AS (
  SELECT page_id, url, string_split_regex(
    regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '<br>', ' ', 'g'), '</?(p|h1)>', chr(1), 'g'), chr(1)) AS parts
  FROM pages),
b AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(
    regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts
  FROM a)
SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text,
  CAST(length(coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '')) AS BIGINT) AS n_chars
FROM b
"""
