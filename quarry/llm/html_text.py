"""Main-text extraction: gradient-boosted trees over DOM-node features, decoded down the tree.

A page becomes a tree of block elements whose leaves are runs of inline text. Each node gets
features: its kind, words in its class, id and role, depth, siblings, and the density of text,
links, paragraphs and punctuation in its subtree. Boosted trees give each node the log odds that
its subtree holds main text. Decoding takes the likeliest labelling in which a node holds main text
only if its parent does, so no ancestor is dropped above a kept descendant; the kept leaves, in
page order, are the text.

The trees are trained here, on pages made by ``example_page`` from a fixed seed whose main text is
known. They are symmetric (one test a level), so a batch of nodes is scored with array operations.

Defined cases: a null or empty page has empty text; broken markup is read as far as it goes, in time
proportional to its length, and open elements end with their parents or the page; text in script, style, head, template and control
elements is never text of the page; every row is judged by itself, so repeated rows and equal ids
are no matter; an empty table gives an empty result; other columns are ignored, whatever their
names. Pages are read whole.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm._common import lean, small_batches, table

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
#: The rest of a tag: quotes count only right after an equals sign. Nothing is tried twice.
_REST = re.compile(r"""(?:=\s*+(?:"[^"]*+"|'[^']*+'|)|[^>=]++)*+>""")
_ZEROS, _PAST_ALL = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,};?")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: Fixed values of HTML: elements without content, elements inside a line, and elements whose content is never page text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
RAW = frozenset("script style title textarea noscript template iframe svg xmp noembed noframes".split())
HIDDEN = frozenset("head button select option datalist canvas object audio video math".split())
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

KINDS = ("#text", "article", "main", "section", "div", "p", "h1", "h2", "ul", "li", "nav", "header", "footer", "aside", "form", "table", "blockquote", "pre", "figure")
#: Words in class, id and role that speak for or against main text, by group.
WORDS = (
    frozenset("article content post entry story body text main page prose copy".split()),
    frozenset("ad ads advert advertisement adverts sponsor sponsored promo promotion banner adsense".split()),
    frozenset("nav navigation menu menubar breadcrumb breadcrumbs crumbs toc pagination pager tabs".split()),
    frozenset("header head masthead topbar logo branding top".split()),
    frozenset("footer foot bottom copyright legal colophon contentinfo".split()),
    frozenset("sidebar side aside rail widget related recommended popular trending complementary more".split()),
    frozenset("comment comments reply replies disqus discussion respond thread reader".split()),
    frozenset("cookie cookies consent notice alert gdpr popup modal overlay warning message".split()),
    frozenset("share sharing social form newsletter subscribe subscription signup login search follow".split()),
)
_SPLIT = re.compile(r"[a-z]+")


@dataclass
class Node:
    parent: int
    kind: str
    depth: int
    flags: int = 0
    text: str = ""
    linked: int = 0
    hidden: bool = False
    children: list[int] = field(default_factory=list)


#: What is remembered of attribute values: this many, none longer than this. Longer ones are read anew.
REMEMBERED, LONGEST = 1 << 14, 1000


def _read_flags(named: str) -> int:
    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()
    return sum(1 << k for k, words in enumerate(WORDS) if words.intersection(_SPLIT.findall(spaced)))


_remembered_flags = lru_cache(REMEMBERED)(_read_flags)


def _flags(named: str) -> int:
    return _remembered_flags(named) if len(named) <= LONGEST else _read_flags(named)


def tokens(page: str) -> Iterator[tuple[str | None, bool, str, int]]:
    """Pieces of a page: (None, False, text, end) or (tag, closing, attributes, end).

    The caller may send a place to go on from. Once a tag's quotes run to the end of the page, or no
    tag end is left, quotes no longer count, so a page is read once whatever is wrong with it.
    """
    at, size, loose = 0, len(page), False
    while at < size:
        start = page.find("<", at)
        if start != at:
            end = size if start < 0 else start
            yield None, False, page[at:end], end
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        name = _NAME.match(page, at + 1)
        if name is None and page[at + 1 : at + 2] not in ("!", "?"):
            yield None, False, "<", at + 1
            at += 1
            continue
        close = page.find(">", at)
        if close < 0:
            yield None, False, page[at:], size
            return
        if name is None:
            at = close + 1
            continue
        rest = None if loose else _REST.match(page, name.end())
        if rest is None:
            loose, end = True, max(close + 1, name.end())
        else:
            end = rest.end()
        sent = yield name[1].lower(), page[at + 1] == "/", page[name.end() : end - 1], end
        at = end if sent is None else sent
        if sent is not None:
            yield None, False, "", at


def _after(page: str, tag: str, at: int) -> int:
    """Where the content of a raw element ends, with its closing tag."""
    found = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
    end = page.find(">", found.end()) if found else -1
    return len(page) if end < 0 else end + 1


def unescaped(text: str) -> str:
    """Character references decoded. Numbers past every character are taken out first: Python reads none of over 4,300 digits."""
    if "&#" in text:
        text = _PAST_ALL.sub("\ufffd", _ZEROS.sub("&#", text))
    return html.unescape(text)


def parse(page: str) -> list[Node]:
    """Blocks in page order, the root first; leaves have kind ``#text``."""
    nodes = [Node(-1, "#root", 0)]
    stack = [0]
    run: list[str] = []
    links = [0, 0]  # open links, characters inside links of the run

    def flush() -> None:
        if run:
            text = " ".join(unescaped("".join(run)).split())
            if text:
                top = stack[-1]
                nodes[top].children.append(len(nodes))
                nodes.append(Node(top, "#text", nodes[top].depth + 1, 0, text, min(links[1], len(text)), nodes[top].hidden))
            run.clear()
        links[1] = 0

    still_open: dict[str, int] = {}

    def drop(first: int) -> None:
        for k in stack[first:]:
            still_open[nodes[k].kind] -= 1
        del stack[first:]

    pieces = tokens(page)
    for tag, closing, piece, at in pieces:
        if tag is None:
            run.append(piece)
            if links[0]:
                links[1] += len(piece)
            continue
        attributes = "" if closing else piece
        if tag in RAW:
            if not closing and not (tag == "svg" and attributes.endswith("/")):
                pieces.send(_after(page, tag, at))
            continue
        if tag in INLINE:
            if tag == "a":
                links[0] = 0 if closing else 1
            continue
        if tag == "br" or (tag in VOID and tag != "hr"):
            run.append(" ")
            continue
        flush()
        links[0] = 0
        if closing:
            if still_open.get(tag):
                drop(next(k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].kind == tag))
            continue
        if tag in _ENDS_P and nodes[stack[-1]].kind == "p":
            drop(len(stack) - 1)
        while len(stack) > 1 and nodes[stack[-1]].kind in _SAME.get(tag, ()):
            drop(len(stack) - 1)
        if tag == "body" and nodes[stack[-1]].kind == "head":
            drop(len(stack) - 1)
        if tag == "hr":
            continue
        top = nodes[stack[-1]]
        named = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)) if "=" in attributes else ""
        top.children.append(len(nodes))
        nodes.append(Node(stack[-1], tag, top.depth + 1, _flags(named) if named else 0, hidden=top.hidden or tag in HIDDEN))
        if not attributes.endswith("/"):
            stack.append(len(nodes) - 1)
            still_open[tag] = still_open.get(tag, 0) + 1
    flush()
    return nodes


N_FEATURES = len(KINDS) + 2 * len(WORDS) + 17


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    length, linked, leaves, paragraphs, marks, items, long_leaves = (np.zeros(n) for _ in range(7))
    for k in range(n - 1, -1, -1):
        node = nodes[k]
        if node.kind == "#text" and not node.hidden:
            length[k], linked[k], leaves[k] = len(node.text), node.linked, 1
            marks[k] = sum(map(node.text.count, ".,;:?!"))
            long_leaves[k] = len(node.text) > 80
        paragraphs[k] += node.kind == "p"
        items[k] += node.kind == "li"
        p = node.parent
        if p >= 0:
            for a in (length, linked, leaves, paragraphs, marks, items, long_leaves):
                a[p] += a[k]
    total = max(length[0], 1.0)
    out = np.zeros((n, N_FEATURES))
    passed, above = np.zeros(n), np.zeros(n, "i8")
    so_far = 0.0
    kinds = {k: i for i, k in enumerate(KINDS)}
    base = len(KINDS)
    tail = base + 2 * len(WORDS)
    inside = np.zeros((n, 6))
    groups = (("article",), ("main",), ("nav", "header", "footer", "aside"), ("ul", "ol", "dl"), ("form",), ("table",))
    for k, node in enumerate(nodes):
        passed[k] = so_far / total
        if node.kind == "#text" and not node.hidden:
            so_far += length[k]
        p = node.parent
        above[k] = (above[p] | nodes[p].flags) if p >= 0 else 0
        if p >= 0:
            inside[k] = inside[p]
        for g, kind in enumerate(groups):
            if node.kind in kind:
                inside[k, g] = 1
        if node.kind in kinds:
            out[k, kinds[node.kind]] = 1
        for w in range(len(WORDS)):
            out[k, base + w] = node.flags >> w & 1
            out[k, base + len(WORDS) + w] = above[k] >> w & 1
    parents = np.array([max(x.parent, 0) for x in nodes])
    siblings = np.array([len(nodes[p].children) for p in parents])
    out[:, tail : tail + 6] = inside
    own = np.maximum(length, 1.0)
    out[:, tail + 6] = np.log1p(length)
    out[:, tail + 7] = linked / own
    out[:, tail + 8] = marks / own
    out[:, tail + 9] = length / total
    out[:, tail + 10] = np.log1p(paragraphs)
    out[:, tail + 11] = np.log1p(items)
    out[:, tail + 12] = long_leaves / np.maximum(leaves, 1)
    out[:, tail + 13] = [min(x.depth, 30) for x in nodes]
    out[:, tail + 14] = np.log1p(siblings)
    out[:, tail + 15] = passed
    out[:, tail + 16] = length / np.maximum(length[parents], 1.0)
    return out


@dataclass(frozen=True)
class Trees:
    """Symmetric trees: per tree and level a feature and a threshold, per tree the leaf values."""

    prior: float
    which: np.ndarray
    above: np.ndarray
    values: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        bits = 1 << np.arange(self.which.shape[1])
        for which, above, values in zip(self.which, self.above, self.values, strict=True):
            out += values[(x[:, which] > above) @ bits]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, damp: float = 5.0, bins: int = 24) -> Trees:
    """Gradient boosting with logistic loss; every level of a tree takes the test that gains most over all its leaves."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    coded = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    odds = np.full(len(y), prior)
    which, above, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        g, h = y - p, p * (1 - p)
        leaf = np.zeros(len(y), "i8")
        tests, at = [], []
        for level in range(depth):
            best = (-1.0, 0, 0)
            for f in range(len(cuts)):
                if not len(cuts[f]):
                    continue
                width = len(cuts[f]) + 1
                cell = leaf * width + coded[f]
                gs = np.bincount(cell, g, (1 << level) * width).reshape(-1, width).cumsum(1)
                hs = np.bincount(cell, h, (1 << level) * width).reshape(-1, width).cumsum(1)
                gl, hl = gs[:, :-1], hs[:, :-1]
                gain = (gl**2 / (hl + damp) + (gs[:, -1:] - gl) ** 2 / (hs[:, -1:] - hl + damp)).sum(0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            _, f, k = best
            tests.append(f)
            at.append(cuts[f][k] if len(cuts[f]) else 0.0)
            leaf |= (coded[f] > k).astype("i8") << level
        gs, hs = np.bincount(leaf, g, 1 << depth), np.bincount(leaf, h, 1 << depth)
        value = rate * gs / (hs + damp)
        odds = odds + value[leaf]
        which.append(tests)
        above.append(at)
        values.append(value)
    return Trees(prior, np.array(which), np.array(above), np.array(values))


def decode(nodes: list[Node], odds: np.ndarray) -> list[str]:
    """Texts of the leaves kept by the likeliest labelling in which kept nodes have kept parents."""
    log_yes, log_no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    n = len(nodes)
    drop, best = log_no.copy(), log_yes.copy()
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent
        drop[p] += drop[k]
        best[p] += max(best[k], drop[k]) if not nodes[k].hidden else drop[k]
    kept = np.zeros(n, bool)
    kept[0] = True
    for k in range(1, n):
        kept[k] = kept[nodes[k].parent] and not nodes[k].hidden and best[k] > drop[k]
    return [x.text for k, x in enumerate(nodes) if x.kind == "#text" and kept[k]]


#: Starts main text in made pages.
MARK = "\ue000"


def example_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A made page, and for each of its text leaves in order whether it is main text.

    Leaves are marked while the page is made: main text starts with one private character, which
    is taken out again by the caller.
    """
    pick, chance = rng.choice, rng.random
    syllables = [a + b for a in "b d f g h l m n p r s t v w th ch sch qu st".split() for b in "a e i o u é ü ei ou an en on er".split()]
    word = lambda: "".join(pick(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(2, 16).capitalize() + pick(". . . ? ! ;".split())
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    yes = MARK
    named = lambda *names: pick(["", f' class="{pick(names)}"', f' id="{pick(names)}"', f' class="{word()} {pick(names)}-{word()}"', f' class="{word()}"'])

    def links(n: int) -> str:
        each = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(n)]
        return pick(["<ul>" + "".join(f"<li>{a}</li>" for a in each) + "</ul>", " | ".join(each), "".join(f"<div>{a}</div>" for a in each)])

    def nav() -> str:
        return pick([f"<nav>{links(rng.randint(2, 9))}</nav>", f"<div{named('menu', 'nav', 'navigation', 'breadcrumb', 'main-menu')}>{links(rng.randint(2, 9))}</div>", f"<div role=\"navigation\">{links(4)}</div>"])

    def header() -> str:
        return pick([f"<header><h1>{words(1, 4)}</h1>{links(3)}</header>", f"<div{named('header', 'masthead', 'topbar')}><p>{words(1, 6)}</p>{pick(['', links(3)])}</div>", f"<header{named('top')}><p>{words(2, 8)}</p></header>"])

    def advert() -> str:
        return f"<div class=\"{pick(['ad', 'ads', 'advert', 'banner', 'sponsored', 'promo', 'ad-' + word()])}\">{pick(['', '<p>'])}{prose(1, 3)}</div>"

    def notice() -> str:
        return f"<div {pick(['class', 'id'])}=\"{pick(['cookie-notice', 'notice', 'alert', 'consent', 'gdpr', 'popup', 'cookies'])}\"><p>{prose(1, 3)}</p>{pick(['', '<button>OK</button>'])}</div>"

    def aside() -> str:
        body = pick([f"<h2>{words(1, 3)}</h2>{links(rng.randint(2, 8))}", f"<p>{prose(1, 4)}</p>", f"<h3>{words(1, 3)}</h3><p>{prose(1, 2)}</p>{links(3)}"])
        return pick([f"<aside>{body}</aside>", f"<aside{named('sidebar', 'related')}>{body}</aside>", f"<div class=\"{pick(['sidebar', 'side', 'related', 'widget', 'recommended', 'right-rail'])}\">{body}</div>"])

    def form() -> str:
        return f"<form{named('search', 'newsletter', 'subscribe', 'login')}><label>{words(1, 4)}</label><input name=q>{pick(['', f'<p>{prose(1, 2)}</p>'])}<button>{word()}</button></form>"

    def comments() -> str:
        one = lambda: pick([f"<li><b>{word()}</b><p>{prose(1, 4)}</p></li>", f"<div class=\"comment\"><p>{prose(1, 5)}</p></div>", f"<p>{prose(1, 3)}</p>"])
        body = f"<h3>{words(1, 3)}</h3>" * (chance() < 0.6) + "".join(one() for _ in range(rng.randint(1, 6)))
        return f"<{(t := pick(['section', 'div', 'ol']))} {pick(['class', 'id'])}=\"{pick(['comments', 'comment-list', 'disqus_thread', 'responses replies', 'reader-comments', 'discussion'])}\">{body}</{t}>"

    def footer() -> str:
        body = pick([f"&copy; {words(1, 3)} &middot; {prose(1, 2)}", f"<p>{prose(1, 3)}</p>", links(rng.randint(2, 6)) + f"<p>{words(2, 6)}</p>"])
        return pick([f"<footer>{body}</footer>", f"<div{named('footer', 'copyright', 'legal')}>{body}</div>"])

    def share() -> str:
        return f"<div class=\"{pick(['share', 'social', 'share-bar', 'newsletter', 'subscribe'])}\">{pick([links(3), f'<p>{prose(1, 2)}</p>'])}</div>"

    def main_part() -> str:
        r = chance()
        if r < 0.62:
            return pick(["<p>", "<p><b>", "<p>"]) + yes + prose(1, 9) + pick(["", f' <a href="#">{words(1, 3)}</a> {sentence()}', "<br>" + prose(1, 2)]) + pick(["</p>", "</p>", ""])
        if r < 0.72:
            return f"<h{(k := rng.randint(2, 4))}>{yes}{words(1, 8)}</h{k}>"
        if r < 0.82:
            return "<ul>" + "".join(f"<li>{yes}{words(2, 14)}" + pick(["", "."]) + "</li>" for _ in range(rng.randint(1, 6))) + "</ul>"
        if r < 0.88:
            return f"<blockquote>{pick(['<p>', ''])}{yes}{prose(1, 4)}</blockquote>"
        if r < 0.92:
            return f"<pre>{yes}{words(4, 20)}</pre>"
        if r < 0.96:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{yes}{words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        return f"<div>{yes}{prose(1, 5)}</div>"

    inner = f"<h1>{yes}{words(1, 10)}</h1>" if chance() < 0.85 else ""
    if inner and chance() < 0.15:
        inner = f"<header>{inner}</header>"
    for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 10, 16])):
        inner += main_part()
        if chance() < 0.06:
            inner += pick([advert, share, aside, form, notice])()
    if chance() < 0.12:
        inner += pick([comments, share, aside])()
    wrap = pick(["article", "article", "article", "main", "div", "section"])
    hint = named("article", "content", "post", "entry", "story", "post-body") if wrap in ("article", "main", "section") else f" class=\"{pick(['content', 'post', 'entry', 'article-body', 'story', 'main-text'])}\""
    main = f"<{wrap}{hint}>{inner}</{wrap}>"
    if chance() < 0.25:
        main = f"<main>{main}{pick(['', comments(), aside(), share()])}</main>"
    before = [f() for f in (nav, header, advert, notice, aside, form) if chance() < 0.4]
    after = [f() for f in (advert, aside, comments, form, notice, share, nav) if chance() < 0.3]
    rng.shuffle(before)
    rng.shuffle(after)
    body = "".join(before) + main + "".join(after) + (footer() if chance() < 0.85 else "")
    if chance() < 0.3:
        body = f"<div{named('page', 'wrapper', 'container')}>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{body}</body></html>", []


@cache
def trained(pages: int = 700, seed: int = 11) -> Trees:
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes = parse(example_page(rng)[0])
        y = np.zeros(len(nodes))
        for k in range(len(nodes) - 1, 0, -1):
            if MARK in nodes[k].text:
                y[k] = 1
                nodes[k].text = nodes[k].text.replace(MARK, "")
            y[nodes[k].parent] = max(y[nodes[k].parent], y[k])
        xs.append(features(nodes))
        ys.append(y)
    return boost(np.concatenate(xs), np.concatenate(ys))


#: Nodes that are scored at a time.
NODES = 20_000


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    out: list[str] = []
    held: list[list[Node]] = []

    def scored() -> None:
        odds = trees.odds(np.concatenate([features(n) for n in held]))
        ends = np.cumsum([len(n) for n in held])
        out.extend(" ".join(decode(n, odds[e - len(n) : e])) for n, e in zip(held, ends, strict=True))
        held.clear()

    for k, page in enumerate(pages):
        held.append(parse(page or ""))
        if sum(map(len, held)) > NODES or k == len(pages) - 1:
            scored()
    return out


def _extract(trees: Trees, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                texts = extract(part.column(at).to_pylist(), trees)
                kept = [c for i, c in enumerate(part.columns) if i != at]
                names = [c for i, c in enumerate(part.schema.names) if i != at]
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*names, "text", "n_chars"])

    return run


def main_text(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages`` (page_id, url, html)."""
    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(lean(_extract(trees or trained(), 2)), f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
