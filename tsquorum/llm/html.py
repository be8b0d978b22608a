"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks, the stretches of text between block-level tags. Each block has features of its
ancestors' tags and class words and of its text. The field labels the blocks main or other; it is trained here, in
numpy, on labelled pages, and decoded by Viterbi.

The labelled pages come from ``labelled_pages``: seeded random pages in many layouts, with articles, menus,
headers, footers, sidebars, notices, adverts, forms and reader comments; ``train`` takes any other pages as well.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Container, Iterator
from functools import lru_cache
from math import fsum
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsquorum.llm.common import released

#: Elements whose content isn't text of the page; without an end tag the first two hold the rest of the page, the others are as any element.
_RAW = ("script", "style", "title", "textarea", "iframe", "noscript")
_RAW_END = {tag: re.compile(rf"(?i)</{tag}(?![A-Za-z0-9-])[^>]*>?") for tag in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS = {  # a start tag ends an open element of these
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_TAG_REST = re.compile(r"""(?:"[^"]*"|'[^']*'|[^'">])*+>""")
#: Tags of a page whose quotes may lead past its end; afterwards every tag ends at the next ``>``.
_ODD_QUOTES = 16
_ATTRIBUTE = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_HIDDEN = re.compile(r"""(?i)\bhidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_CLASS_WORD = re.compile(r"[a-z]+")


class Block(NamedTuple):
    text: str
    #: Features of all open elements, and the innermost one that isn't inline.
    above: frozenset[str]
    own: str
    linked: int
    hidden: bool


class _Element(NamedTuple):
    tag: str
    above: frozenset[str]
    own: str
    linked: bool
    hidden: bool


def _tokens(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(text, tag, attributes, is an end tag) in order; text and tag exclude each other. Time is linear in the page's length."""
    at, text, last = 0, 0, page.rfind(">")
    last_comment, odd, no_end = page.rfind("-->"), 0, set()
    while (at := page.find("<", at)) >= 0 and at < last:
        name = None
        if page.startswith("<!--", at) and last_comment >= at + 2:
            end = page.find("-->", at + 2) + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
        elif name := _NAME.match(page, at):
            rest = _TAG_REST.match(page, name.end()) if odd < _ODD_QUOTES else None
            odd += rest is None
            end = rest.end() if rest else page.find(">", name.end()) + 1
        if not name and not page.startswith(("<!", "<?"), at):
            at += 1
            continue
        if text < at:
            yield page[text:at], "", "", False
        if name:
            tag, closing, attributes = name[1].lower(), page.startswith("</", at), page[name.end() : end - 1]
            if tag in _RAW_END and not closing and not attributes.endswith("/"):
                found = None if tag in no_end else _RAW_END[tag].search(page, end)
                if found or tag in _RAW[:2]:
                    tag, end = "raw", found.end() if found else len(page)
                else:
                    no_end.add(tag)
            yield "", tag, attributes, closing
        at = text = end
    if text < len(page):
        yield page[text:], "", "", False


def leaf_blocks(page: str | None, known: Container[str] | None = None) -> list[Block]:
    """The page's leaf blocks in order: references decoded, white space made one blank, trimmed, empty ones left out.

    With ``known``, only those features of open elements are kept, which bounds what a block holds.
    """
    blocks: list[Block] = []
    stack, opened = [_Element("", frozenset(), "", False, False)], Counter()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip(" ")
            if text:
                top = stack[-1]
                blocks.append(Block(text, top.above, top.own, min(linked, len(text)), top.hidden))
            parts.clear()
        linked = 0

    def close() -> str:
        tag = stack.pop().tag
        opened[tag] -= 1
        return tag

    for text, tag, attributes, closing in _tokens(page or ""):
        if text:
            parts.append(text)
            if stack[-1].linked:
                linked += len(text.strip())
        elif tag == "raw":
            parts.append(" ")
        elif closing:
            if tag not in _INLINE:
                flush()
            if opened[tag]:
                while close() != tag:
                    pass
        else:
            if tag not in _INLINE:
                flush()
                while opened["p"] and stack[-1].tag in _INLINE:
                    close()
                if stack[-1].tag == "p":
                    close()
                for other in _ENDS.get(tag, ()):
                    if any(e.tag == other for e in stack[-3:]):
                        while close() != other:
                            pass
            elif tag == "br":
                parts.append(" ")
            if tag not in _VOID:
                top, has = stack[-1], [f"tag:{tag}"]
                if attributes:
                    has += [f"class:{w}" for a in _ATTRIBUTE.finditer(attributes) for w in _CLASS_WORD.findall((a[1] or a[2] or a[3] or "").lower())]
                new = [f for f in has if f not in top.above and (known is None or f in known)]
                hidden = top.hidden or tag == "template" or bool(attributes and _HIDDEN.search(attributes))
                stack.append(_Element(tag, top.above.union(new) if new else top.above, top.own if tag in _INLINE else tag, top.linked or tag == "a", hidden))
                opened[tag] += 1
    flush()
    return blocks


_STEPS = (15, 30, 60, 120, 250, 500)


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that each block has."""
    out = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        has = [*b.above, f"own:{b.own}"]
        has += [f"longer:{s}" for s in _STEPS if n > s]
        has.append("linked:" + ("all" if b.linked >= 0.8 * n else "part" if b.linked > 0.3 * n else "little"))
        has.append("stop" if b.text[-1] in ".!?…\"'”»" else "nostop")
        if b.text.count(",") + b.text.count(".") >= 3:
            has.append("sentences")
        if "©" in b.text or "copyright" in b.text.lower():
            has.append("copyright")
        if b.hidden:
            has.append("hidden")
        has.append("first" if i == 0 else "last" if i == len(blocks) - 1 else "inner")
        out.append(has)
    return out


class Field(NamedTuple):
    """Weights of the features for (other, main), of moving between labels, and of the first label."""

    weights: dict[str, tuple[float, float]]
    moves: tuple[tuple[float, float], tuple[float, float]]
    start: tuple[float, float]


def train(pages: list[tuple[str, list[bool]]], *, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3, least_seen: int = 3) -> Field:
    """Maximum likelihood by gradient steps (Adam), with an L2 penalty; pages are (html, is main per leaf block)."""
    rows = [(features(leaf_blocks(page)), labels) for page, labels in pages]
    rows = [(f, y) for f, y in rows if f]
    seen: dict[str, int] = {}
    for f, _ in rows:
        for name in {x for has in f for x in has}:
            seen[name] = seen.get(name, 0) + 1
    names = {x: i for i, x in enumerate(sorted(k for k, n in seen.items() if n >= least_seen))}
    width, longest = len(names), max(len(y) for _, y in rows)
    x = np.zeros((len(rows), longest, width), np.float32)
    y = np.zeros((len(rows), longest), int)
    there = np.zeros((len(rows), longest), bool)
    for r, (f, labels) in enumerate(rows):
        there[r, : len(labels)], y[r, : len(labels)] = True, labels
        for t, has in enumerate(f):
            x[r, t, [names[n] for n in has if n in names]] = 1
    hot = np.eye(2)[y] * there[..., None]
    pairs = (hot[:, :-1, :, None] * hot[:, 1:, None, :]).sum(axis=(0, 1))
    parts = [np.zeros((width, 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, rounds + 1):
        w, moves, start = parts
        score = x @ w
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + start
        for t in range(1, longest):
            ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + score[:, t]
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(moves + (score[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(there[:, t + 1, None], new, 0)
        total = np.logaddexp.reduce(ahead[:, 0] + back[:, 0], axis=1)[:, None, None]
        one = np.exp(np.minimum(ahead + back - total, 0)) * there[..., None]
        two = np.exp(np.minimum(ahead[:, :-1, :, None] + moves + (score + back)[:, 1:, None, :] - total[..., None], 0)) * there[:, 1:, None, None]
        gradients = [np.tensordot(x, hot - one, axes=([0, 1], [0, 1])), pairs - two.sum(axis=(0, 1)), (hot[:, 0] - one[:, 0]).sum(axis=0)]
        for p, g, a, b in zip(parts, gradients, first, second, strict=True):
            g = g / len(rows) - decay * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    w, moves, start = parts
    return Field({n: (float(w[i, 0]), float(w[i, 1])) for n, i in names.items()}, tuple(map(tuple, moves.tolist())), tuple(start.tolist()))


def decode(field: Field, blocks: list[Block]) -> list[bool]:
    """The likeliest labels of the blocks together (Viterbi)."""
    if not blocks:
        return []
    (oo, om), (mo, mm) = field.moves
    weights, back = field.weights, []
    other, main = field.start
    for i, has in enumerate(features(blocks)):
        known = [weights[n] for n in has if n in weights]
        a, b = fsum(k[0] for k in known), fsum(k[1] for k in known)  # in any order
        if i:
            from_other, from_main = (other + oo, main + mo), (other + om, main + mm)
            back.append((from_other[1] > from_other[0], from_main[1] > from_main[0]))
            other, main = max(from_other), max(from_main)
        other, main = other + a, main + b
    labels = [main > other]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def main_text(field: Field, page: str | None) -> str:
    blocks = leaf_blocks(page, field.weights)
    return "\n".join(b.text for b, keep in zip(blocks, decode(field, blocks), strict=True) if keep)


# ------------------------------------------------------------------------------------------ labelled pages

_ARTICLES = ('<article>|</article>', '<main>|</main>', '<main><article class="post">|</article></main>', '<div id="content">|</div>', '<div class="post-body entry-content">|</div>', '<section class="article-body">|</section>', '<div class="story"><div class="text">|</div></div>', '<div role="main">|</div>', "<div>|</div>", '<table><tr><td class="content">|</td></tr></table>')
_MENUS = ('<nav><ul>|</ul></nav>', '<div class="menu"><ul>|</ul></div>', '<ul id="navigation">|</ul>', '<div class="navbar" role="navigation"><ul>|</ul></div>', '<div class="breadcrumbs"><ul>|</ul></div>', '<nav class="toc"><ol>|</ol></nav>', '<header><nav><ul>|</ul></nav></header>', '<div class="tags"><ul>|</ul></div>')
_SIDES = ('<aside>|</aside>', '<div class="sidebar">|</div>', '<div id="right-rail" class="widget">|</div>', '<section class="related">|</section>', '<div class="recommended">|</div>', '<div class="author-bio promo">|</div>')
_ADS = ('<div class="ad">|</div>', '<div class="advert banner">|</div>', '<div id="ads-top">|</div>', '<section class="sponsored">|</section>', '<div class="promo">|</div>', '<ins class="adsbygoogle">|</ins>', '<aside class="advertisement">|</aside>')
_NOTICES = ('<div class="cookie-notice">|</div>', '<div id="cookie-banner" role="dialog">|</div>', '<div class="alert notice">|</div>', '<div class="gdpr consent">|</div>', '<div class="notice">|</div>', '<div class="newsletter popup modal">|</div>', '<div role="alert">|</div>')
_FEET = ('<footer>|</footer>', '<div id="footer">|</div>', '<div class="site-footer legal">|</div>', '<div class="copyright">|</div>')
_HEADS = ('<header>|</header>', '<div id="header">|</div>', '<div class="masthead">|</div>', '<header class="site-header">|</header>')
_TALK = ('<section class="comments">|</section>', '<div id="comments">|</div>', '<div class="comment-list"><div class="comment">|</div></div>', '<section id="respond" class="discussion">|</section>', '<ul class="comments replies"><li>|</li></ul>', '<section class="user-comments"><article class="comment">|</article></section>', '<div class="disqus-thread reviews">|</div>')


def _sentence(rng: np.random.Generator, least: int = 4, most: int = 22) -> str:
    parts = "an be co de er fi gu ha in ju ka le mo na or pe qui re sa ti un ver wo za é ü ñ".split()
    words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(least, most))]
    for i in np.flatnonzero(rng.random(len(words) - 1) < 0.12):
        words[i] += ","
    return " ".join(words).capitalize() + str(rng.choice([".", ".", ".", "?", "!"]))


def _words(rng: np.random.Generator, most: int = 4) -> str:
    return _sentence(rng, 1, most)[:-1] if most > 1 else _sentence(rng, 1, 2)[:-1]


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, list[bool]]]:
    """Random pages with the label of each leaf block; the same for the same seed."""
    rng = np.random.default_rng(seed)
    one = lambda options: str(options[rng.integers(len(options))])
    pages = []
    for _ in range(n):
        labels: list[bool] = []

        def put(text: str, main: bool, tag: str = "p", labels: list[bool] = labels) -> str:
            labels.append(main)
            return f"<{tag}>{text}" + ("" if tag == "p" and rng.random() < 0.15 else f"</{tag}>")

        def prose(k: int) -> str:
            return " ".join(_sentence(rng) for _ in range(k))

        def inline(text: str) -> str:
            words = text.split(" ")
            i = int(rng.integers(len(words)))
            words[i] = one(("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>", "{}&amp;", "{}<br>")).format(words[i])
            return " ".join(words)

        def menu(k: int) -> str:
            return one(_MENUS).replace("|", "".join(put(f'<a href="/{i}">{_words(rng)}</a>', False, "li") for i in range(k)))

        def side() -> str:
            inner = put(_words(rng), False, "h3") + "".join(put(f'<a href="/r{i}">{_words(rng, 9)}</a>', False, one(("p", "div", "h4"))) for i in range(rng.integers(1, 5)))
            return one(_SIDES).replace("|", inner + (put(prose(1), False) if rng.random() < 0.4 else ""))

        def plain(shells: tuple[str, ...], k: int) -> str:
            shell = one(shells)
            if rng.random() < 0.5:
                labels.append(False)
                return shell.replace("|", prose(k))
            return shell.replace("|", "".join(put(_sentence(rng), False, one(("p", "div"))) for _ in range(k)))

        def form() -> str:
            fields = "".join(put(_words(rng), False, one(("label", "legend", "button", "p"))) + "<input name=x>" for _ in range(rng.integers(1, 4)))
            return f'<form{one(("", " class=search", " id=subscribe"))}>{fields}</form>'

        def talk() -> str:
            inner = put(_words(rng), False, "h4")
            for _ in range(rng.integers(1, 6)):
                inner += put(_words(rng), False, one(("span", "div", "cite")).replace("span", "div").replace("cite", "h5")) + put(prose(int(rng.integers(1, 4))), False)
            return one(_TALK).replace("|", inner)

        def article() -> str:
            head = put(_words(rng, 10), True, one(("h1", "h1", "h2")))
            inner = f"<header>{head}</header>" if rng.random() < 0.15 else head
            for _ in range(rng.integers(1, 12)):
                kind = rng.random()
                if kind < 0.62:
                    inner += put(inline(prose(int(rng.integers(1, 6)))), True)
                elif kind < 0.72:
                    inner += put(_words(rng, 6), True, one(("h2", "h3")))
                elif kind < 0.8:
                    inner += "<ul>" + "".join(put(_sentence(rng), True, "li") for _ in range(rng.integers(2, 5))) + "</ul>"
                elif kind < 0.85:
                    inner += put(prose(1), True, one(("blockquote", "pre", "figcaption")))
                elif kind < 0.88:
                    inner += "<table><tr>" + "".join(put(_words(rng), True, "td") for _ in range(3)) + "</tr></table>"
                elif kind < 0.92:
                    inner += plain(_ADS, 1)
                elif kind < 0.95:
                    inner += side()
                elif kind < 0.97:
                    inner += form()
                else:
                    inner += put(_sentence(rng, 1, 5), True)
            return one(_ARTICLES).replace("|", inner)

        some = lambda p: rng.random() < p
        body = ""
        if some(0.4):
            body += plain(_NOTICES, 1)
        if some(0.5):
            body += one(_HEADS).replace("|", put(_words(rng), False, one(("div", "p", "h2"))))
        if some(0.85):
            body += menu(int(rng.integers(2, 9)))
        if some(0.3):
            body += form()
        if some(0.6):
            body += f"<!-- ad {rng.integers(99)} -->" + plain(_ADS, int(rng.integers(1, 3)))
        if some(0.25):
            body += side()
        body += article()
        for p, make in ((0.2, lambda: plain(_ADS, 1)), (0.35, side), (0.3, talk), (0.2, form), (0.15, lambda: menu(4)), (0.2, lambda: plain(_NOTICES, 1)), (0.85, lambda: plain(_FEET, 1))):
            if some(p):
                body += make()
        page = f"<!DOCTYPE html><html><head><title>{_words(rng)}</title><style>p{{margin:0}}</style></head><body>{body}<script>var a='</p>';</script></body></html>"
        if len(leaf_blocks(page)) == len(labels):
            pages.append((page, labels))
    return pages


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages(600))


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url", field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_main, n_blocks) per row: the main blocks' text, joined by newlines.

    Null or empty html gives an empty text. A page of any length and nesting takes time in proportion to its length.
    An unclosed comment ends at the next ``>``, an unclosed script or style with the page. One pass over whole pages without a shuffle. Null ids, null URLs and
    repeated rows are rows like any other; columns other than the named ones aren't read; no rows, no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                texts, mains, counts = [], [], []
                for page in batch.column(2).to_pylist():
                    blocks = leaf_blocks(page, shared.value.weights)
                    keep = decode(shared.value, blocks)
                    texts.append("\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k))
                    mains.append(sum(keep)), counts.append(len(blocks))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(mains, pa.int64()), pa.array(counts, pa.int64())], ["page_id", "url", "text", "n_main", "n_blocks"])

    url = F.col(url_col) if url_col else F.lit(None)
    slim = pages.select(F.col(id_col).alias("page_id"), url.cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(released(run), f"page_id {slim.schema['page_id'].dataType.simpleString()}, url string, text string, n_main bigint, n_blocks bigint")
