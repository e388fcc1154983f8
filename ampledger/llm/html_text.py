"""Main text of web pages: a linear-chain CRF over DOM leaf blocks.

A page becomes its leaf blocks in page order, each with the open elements above it. A
chain trained on labelled pages, with ancestor-tag and text features, is decoded by
Viterbi, and the blocks labelled as content are joined. Labelled pages are the hand-marked
layouts below and a bounded sample of the table's own pages whose markup names its article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.llm import crf
from ampledger.llm.common import map_rows, table

TRAIN_PAGES = 200  # pages of the table that are fitted on, at most; all their blocks count
CHUNK_BLOCKS = 4096  # blocks of a page whose features are held at once

_ATTRS = r"""(?:\s++|/|[^\s/>=]?+[^\s/>=]*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)|[^\s/>=]++)*+"""
_TAG = re.compile(rf"<(?:(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})>|(?P<note>!--)|(?P<decl>[!?/]))")
_NOTE_END = re.compile(r"--!?>")
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")

#: Elements whose content is no text of the page.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg", "annotation", "annotation-xml"}
FOREIGN = {"svg", "annotation", "annotation-xml"}  # of these, the ones that "/>" closes
#: Elements that can stand in head; any other ends it, as text does.
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr input button select option optgroup "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup "
    "munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_P_HOLDERS = ("button", "table", "td", "th", "object")
_NOT_P = CLOSES_P - {"p"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

TAGS = (
    "article main section div p ul ol li dl table td blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 "
    "nav header footer aside form fieldset details dialog menu address body search"
).split()
#: Words in class, id and role that hint at a part's purpose.
HINTS = {
    "menu": r"nav|menu|breadcrumb|toolbar|tabs|pagination|pager|skip|toc",
    "foot": r"foot|copyright|contentinfo|colophon|legal",
    "head": r"(?<![a-z])head(er)?(?!line)|masthead|banner|topbar|logo",
    "side": r"side|widget|related|recommend|complementary|rail|more-from|trending|popular|also",
    "advert": r"(?<![a-z])ads?(?![a-z])|advert|sponsor|promo|adsense|adbox|outbrain|taboola",
    "notice": r"cookie|notice|consent|gdpr|alert|popup|modal|overlay|newsletter|subscri|signup|paywall|dialog|toast",
    "comment": r"comment|disqus|reply|replies|respond|discussion|feedback",
    "share": r"share|social|follow|rating",
    "form": r"form|search|login|register",
    "content": r"content|article|post|entry|story|text|main|prose|body",
}
_HINTS = [re.compile(p) for p in HINTS.values()]
_WORD = re.compile(r"\w+")
_BOILER = re.compile(r"[©®|»›]|\b(?:cookies?|subscribe|newsletter|sign (?:in|up)|log ?in|rights reserved|advertisement|sponsored|read more|share)\b", re.I)
FEATURES = 1 + 2 * len(TAGS) + 2 * len(HINTS) + 13


_OUT = {"nav", "header", "footer", "aside", "form", "fieldset", "dialog", "menu", "search"}
_NOT = re.compile("|".join(f"(?:{HINTS[k]})" for k in ("menu", "foot", "side", "advert", "notice", "comment", "share", "form")))


_PLACE = {t: k for k, t in enumerate(TAGS)}
_NAMED = (1 << _PLACE["article"]) | (1 << _PLACE["main"])  # article or main above


class Element:
    """An open element, with what its blocks need to know of all elements above: each takes constant space."""

    __slots__ = ("name", "tags", "inner", "hints", "last", "mark", "depth", "head", "part")

    def __init__(self, above: Element | None = None, name: str = "", hint: str = "", hint_bits: int = 0, mark: str = ""):
        self.name, bit = name, 1 << _PLACE[name] if name in _PLACE else 0
        if above is None:
            self.tags = self.inner = self.hints = self.last = self.depth = self.part = 0
            self.mark, self.head = "", False
            return
        self.tags, self.inner = above.tags | bit, bit  # TAGS above, and of them the innermost
        self.hints, self.last = above.hints | hint_bits, hint_bits or above.last  # HINTS above, and the innermost
        self.mark = mark or above.mark  # innermost data-y, in hand-marked pages
        self.depth, self.head = above.depth + 1, above.head or name == "head"
        # 0 outside of any article, 1 in its content, 2 in a part of it marked otherwise
        if above.part:
            self.part = 2 if above.part == 2 or name in _OUT or (hint and _NOT.search(hint)) else 1
        else:
            self.part = int(name == "article")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    at: Element


def _self_closed(attrs: str) -> bool:
    """Whether the attributes end in a slash that belongs to no unquoted value."""
    if not attrs.endswith("/"):
        return False
    body = attrs[:-1]
    begin = 1 + max((body.rfind(c) for c in " \t\n\r\f\v\"'>"), default=-1)
    tail = body[begin:]
    if "=" in tail:
        return tail.index("=") == len(tail) - 1
    return not (tail and body[:begin].rstrip().endswith("="))


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks: stretches of text between the tags of block elements, white space as one space, empty ones left out.

    Character references are decoded, inline elements leave no gap, br is white space. A tag
    cut off by the page's end is dropped, end tags without a start are ignored, and p, li and
    table cells end where the next one or an enclosing element begins or ends. head ends at text
    and at the first element that cannot stand in it. Formulas and what object falls back to are
    text; drawings are not. Time and memory grow with the length of the page, however deep it
    nests: places of open elements are kept by name, and every element is left once.
    """
    page = page or ""
    stack = [Element()]
    open_at: dict[str, list[int]] = {}  # places in the stack, by name
    hint_bits: dict[str, int] = {}
    out: list[Block] = []
    parts: list[str] = []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text and not stack[-1].head:
                out.append(Block(text, linked, stack[-1]))
        linked = 0

    def leave(k: int) -> None:
        for gone in stack[k:]:
            open_at[gone.name].pop()
        del stack[k:]

    def close(name: str, upto: Iterable[str] = ()) -> None:
        """End the innermost open ``name``, unless an element of ``upto`` stands before it."""
        at = open_at.get(name)
        if at and not any(held[-1] > at[-1] for u in upto if (held := open_at.get(u))):
            leave(at[-1])

    def leave_head() -> None:
        if at := open_at.get("head"):
            leave(at[0])

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            data = html.unescape(page[at : lt if lt >= 0 else n])
            if data.strip():
                leave_head()
            parts.append(data)
            if links:
                linked += len(data)
            if lt < 0:
                break
        m = _TAG.match(page, lt)
        if not m:
            if lt + 1 < n and (page[lt + 1].isascii() and page[lt + 1].isalpha()):
                break  # a tag that the page's end cuts off
            leave_head()
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m["note"]:
            end = _NOTE_END.search(page, at - 2 if page.startswith(">", at) or page.startswith("->", at) else at)
            at = end.end() if end else n
            continue
        if m["decl"]:
            if lt + 2 < n and page[lt + 1] == "/" and page[lt + 2].isalpha():
                break
            end = page.find(">", at - 1)
            at = end + 1 if end >= 0 else n
            continue
        name = m["name"].lower()
        if not m["end"] and name not in IN_HEAD:
            leave_head()
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                links = 0 if m["end"] else 1
            continue
        flush()
        if m["end"]:
            close(name, _NOT_P if name == "p" else ())
            continue
        if name in RAW:
            if name in FOREIGN and _self_closed(m["attrs"]):
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in CLOSES_P:
            close("p", _P_HOLDERS)
        for other in _SIBLINGS.get(name, ()):
            close(other, _HOLDERS[name])
        if name in VOID or m["attrs"].endswith("/") and name not in CLOSES_P:
            continue
        hint, mark = "", ""
        if m["attrs"]:
            found = []
            for a in _ATTR.finditer(m["attrs"]):
                if a[1].lower() in ("class", "id", "role", "aria-label"):
                    found.append((a[2] or a[3] or a[4] or "").lower())
                elif a[1] == "data-y":
                    mark = a[2] or ""
            hint = "".join(" " + f for f in found)
        if hint and hint not in hint_bits:
            hint_bits[hint] = sum(1 << i for i, p in enumerate(_HINTS) if p.search(hint))
        open_at.setdefault(name, []).append(len(stack))
        stack.append(Element(stack[-1], name, hint, hint_bits.get(hint, 0), mark))
    flush()
    return out


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def features(blocks: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """(last - first, FEATURES) of these of the page's blocks: ancestor tags and hints (any; innermost), text figures, place in the page."""
    last = len(blocks) if last is None else last
    x = np.zeros((last - first, FEATURES))
    known: dict[tuple[int, int, int, int], np.ndarray] = {}
    a, b = 1 + len(TAGS), 1 + 2 * len(TAGS)
    c = b + len(HINTS)
    d = c + len(HINTS)
    for k in range(first, last):
        block = blocks[k]
        row, text, at = x[k - first], block.text, block.at
        key = (at.tags, at.inner, at.hints, at.last)
        if key not in known:
            above = known[key] = np.zeros(d)
            above[0] = 1.0
            for start, mask in zip((1, a, b, c), key, strict=True):
                for i in _bits(mask):
                    above[start + i] = 1.0
        row[:d] = known[key]
        words, size, boiler = len(_WORD.findall(text)), len(text), bool(_BOILER.search(text))
        row[d:] = (
            min(np.log1p(words), 6.0), float(words < 4), float(words > 20), block.linked / size, float(block.linked >= 0.8 * size),
            float(text[-1] in ".!?…:\"”"), float(boiler), float(words < 12 and boiler),
            sum(map(str.isdigit, text)) / size, float(k == 0), float(k == len(blocks) - 1),
            min(at.depth, 12) / 12, float(at.tags & _NAMED != 0),
        )
    return x


def labels_by_markup(blocks: list[Block]) -> list[int] | None:
    """Content is what the page's article holds outside of parts marked otherwise; None if the page names no article."""
    return [int(b.at.part == 1) for b in blocks] if any(b.at.part for b in blocks) else None


def hand_marked_pages() -> Iterator[str]:
    """Layouts with data-y="1" on content and data-y="0" on what is not (the innermost mark counts), told over several texts."""
    prose = (
        "The river rose in the night and by morning the lower road was gone.",
        "Short one.",
        "Nobody had expected the vote to be close, least of all the people who had counted on it; by noon the square was full and the talk had turned to what would follow.",
        "In 1984 the mill closed. Twelve families left that year, and the school lost its second teacher.",
        "He said: it depends.",
    )
    menu = '<ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li><li><a href="/c">Sport</a></li></ul>'
    foot = "© Example Press. All rights reserved."
    cookie = "We use cookies to improve your visit. Accept all?"
    advert = "Save half on new boots this week only."
    side = '<h3>Most read</h3><p><a href="/1">Ten ways to cook rice</a></p><p>The best walks near the town.</p>'
    reader = "<h3>Comments</h3><p>Great piece, I was there too and it was just as you say.</p><div>anna: Not true at all.</div>"
    form = '<form class="newsletter"><p>Join our list and get the day\'s news by mail.</p><label>Mail</label><input><button>Send</button></form>'
    outer = (
        ("<article>", "</article>"), ("<main>", "</main>"), ('<main id="content"><article class="post">', "</article></main>"),
        ('<div class="article-body">', "</div>"), ('<div id="content"><div class="entry-content">', "</div></div>"),
        ('<section class="story">', "</section>"), ('<div role="main">', "</div>"), ('<div class="post"><div class="text">', "</div></div>"),
    )
    frames = (
        ("<header><h1>Example Press</h1><p>News since 1901</p></header><nav>{menu}</nav>", "<aside>{side}</aside><footer><p>{foot}</p></footer>"),
        ('<div class="header">Example Press</div><div class="menu">{menu}</div>', '<div class="sidebar">{side}</div><div class="footer">{foot}</div>'),
        ('<div id="masthead">Example Press</div><div role="navigation">{menu}</div><div class="cookie-notice">{cookie}</div>', '<div role="complementary">{side}</div><div role="contentinfo">{foot}</div>'),
        ('<div class="cookie-banner"><p>{cookie}</p></div><nav>{menu}</nav><div class="ad">{advert}</div>', "<footer>{foot} <span>Imprint</span></footer>"),
        ("<nav>{menu}</nav>", '<section id="comments">{reader}</section><div class="related-posts">{side}</div><footer>{foot}</footer>'),
        ('<div class="topbar">{menu}</div><div class="advert">{advert}</div>', '<div class="comments">{reader}</div>{form}<footer>{foot}</footer>'),
    )
    inserts = (
        "", '<div class="ad" data-y="0">{advert}</div>', '<aside data-y="0">{side}</aside>', '<form data-y="0"><p>Log in to read on.</p></form>',
        '<div class="share" data-y="0">Share this</div>', '<section class="comments" data-y="0">{reader}</section>', '<nav data-y="0">{menu}</nav>',
        '<footer data-y="0"><p>Filed under: Towns</p></footer>', '<header data-y="0"><p>By A. Writer, 3 May</p></header>',
        '<div class="newsletter-signup" data-y="0">Get the day\'s news by mail.</div>',
    )
    fill = {"menu": menu, "foot": foot, "cookie": cookie, "advert": advert, "side": side, "reader": reader, "form": form}
    bodies = (
        "<h1>{0}</h1><p>{2}</p>{i}<p>{1}</p><p>{3}</p><p>{4}</p>",
        "<h2>{1}</h2><p><b>{0}<br>{4}</b></p>{i}<ul><li>{3}</li><li>{1}</li></ul><blockquote>{2}</blockquote>",
        "<h1>{4}</h1>{2}<div>{0}</div>{i}<div>{3}</div><table><tr><td>{1}</td><td>{4}</td></tr></table>",
    )
    for k, (a, z) in enumerate(outer):
        for j, (before, after) in enumerate(frames):
            for q, body in enumerate(bodies):
                told = [prose[(n + k + j + q) % len(prose)] for n in range(len(prose))]
                inner = body.format(*told, i=inserts[(3 * k + 5 * j + q) % len(inserts)].format(**fill))
                start = re.sub(r"^<(\w+)", r'<\1 data-y="1"', a)
                yield f'<html><body data-y="0">{before.format(**fill)}{start}{inner}{z}{after.format(**fill)}</body></html>'
    # parts alone, by tag or by class, with short and long text; and pages without any container
    parts = [f"<{t}>{{}}</{t}>" for t in ("nav", "header", "footer", "aside", "form", "dialog", "menu")]
    parts += [f'<div class="{c}">{{}}</div>' for c in ("menu", "footer", "sidebar", "advert", "cookie-notice", "comments", "share", "related")]
    for part in parts:
        for text in ("Home", menu, f"<p>{prose[0]}</p><p>{prose[2]}</p>"):
            yield f'<html><body data-y="0">{part.format(text)}</body></html>'
            yield f'<html><body data-y="0">{part.format(text)}<article data-y="1"><p>{prose[3]}</p><p>{prose[1]}</p></article></body></html>'
            yield f'<html><body data-y="0">{part.format(text)}<div data-y="1"><h1>{prose[1]}</h1><p>{prose[2]}</p><p>{prose[4]}</p></div></body></html>'


def _marked_labels(blocks: list[Block]) -> list[int]:
    return [int(b.at.mark or "0") for b in blocks]


def train_pages(pages: list[str]) -> crf.Crf:
    """The chain, from the hand-marked layouts and from those of ``pages`` that name an article."""
    chains = []
    for page in hand_marked_pages():
        found = blocks_of(page)
        chains.append((features(found), np.array(_marked_labels(found))))
    for page in pages:
        found = blocks_of(page)
        labels = labels_by_markup(found)
        if labels:
            chains.append((features(found), np.array(labels)))
    return crf.train(chains)


def main_text(model: crf.Crf, page: str | None) -> str:
    found = blocks_of(page)
    if not found:
        return ""
    spans = [(k, min(k + CHUNK_BLOCKS, len(found))) for k in range(0, len(found), CHUNK_BLOCKS)]
    scores = np.concatenate([model.emissions(features(found, *span)) for span in spans])
    return " ".join(b.text for b, y in zip(found, model.decode(scores), strict=True) if y)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", train_pages_bound: int = TRAIN_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``; n_chars counts code points.

    Null and empty pages, and pages without content, have an empty text. Repeated rows give
    repeated results; columns besides id, url and html are not read; an empty table gives an
    empty result (the chain is then trained on the hand-marked layouts alone). Long pages are
    read whole, in linear time.
    """
    chosen = pages.where(F.col(html_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string"), html_col).alias("h"))
    last = chosen.orderBy("h").limit(train_pages_bound).agg(F.max("h").alias("h")).first()["h"]  # only hashes are sorted
    sample = pages.where(F.xxhash64(F.col(id_col).cast("string"), html_col) <= F.lit(last)).select(html_col).limit(train_pages_bound)
    model = train_pages([r[0] for r in sample.toLocalIterator()] if last is not None else [])

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(model, p) for p in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

        return each

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url"), F.col(html_col))
    return map_rows(picked, make, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
