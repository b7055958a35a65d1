"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of words and tags. Every word scores +1 where its surroundings look like content and -1
where they do not, every tag costs a little; the weights behind both come from labelled pages (log-odds of finding a
word inside the main text, given the elements, classes, ids and roles around it). One linear scan finds the contiguous
region with the largest sum. From that region the words whose surroundings are content are kept, block by block.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import PAGES

#: A quote opens a value only right after "="; elsewhere, as in an unquoted value, it is a character like any other.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*"|=\s*+'[^']*'|[^>])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<""",
    re.S,
)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: What these elements hold is never text of the page (their end is looked for as it stands).
RAW = frozenset("script style noscript template iframe object svg canvas textarea select noframes title audio video math xmp".split())
#: Of those, the ones that can be empty (<svg/>) and stand in one another.
FOREIGN = frozenset(("svg", "math"))
#: Elements that stay open until they are closed; their names and attributes are the surroundings of a word.
NESTING = frozenset("html body div section article main nav header footer aside form ul ol menu table blockquote figure dialog fieldset details center head button label address dl".split())
#: Elements that end the block before them and after them.
BLOCKS = NESTING - {"button", "label"} | frozenset("p h1 h2 h3 h4 h5 h6 li tr dt dd pre hr figcaption caption tbody thead tfoot summary legend option title".split())
#: Elements that separate words but no blocks.
GAPS = frozenset("br td th img input".split())
#: Score of a word in a link outside marked content.
LINK = -0.5
#: Containers that a page's author marked as its content.
MARKED = frozenset(["tag:article", "tag:main", "role:main"])


@lru_cache(50_000)
def features(name: str, attrs: str) -> tuple[tuple[str, ...], bool]:
    """The features of an element, and whether it is hidden."""
    out, hidden = [f"tag:{name}"], False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "style":
            hidden |= bool(_HIDDEN.search(value))
        elif key in ("hidden", "aria-hidden"):
            hidden |= value.lower() not in ("false", "no")
        elif key == "role":
            out.append(f"role:{value.lower()}")
        else:
            out += {f"name:{p.lower()}" for p in _PART.findall(value)}
    return tuple(out), hidden


class Weights:
    """Log-odds of the features of containers, and the cost of each tag."""

    def __init__(self, pages: list[str]):
        inside, outside, tags_in, tags_out = Counter(), Counter(), Counter(), Counter()
        for page in pages:
            on = False
            for kind, value, stack in walk(page.replace("[[", "<b data-on>").replace("]]", "</b data-on>")):
                if kind == "tag" and "data-on" in value[1]:
                    on = value[2]
                elif kind == "tag":
                    (tags_in if on else tags_out)[value[0]] += 1
                else:
                    n = len(value.split())
                    for f in {f for fs, _ in stack for f in fs}:
                        (inside if on else outside)[f] += n
        every = log((sum(inside.values()) + 1) / (sum(outside.values()) + 1))
        self.of = {f: max(-5.0, min(5.0, log((inside[f] + 0.5) / (outside[f] + 0.5)) - every)) for f in inside | outside}
        # containers that hold everything tell nothing; marked content outweighs what is around it
        neutral = ("html", "body", "div", "section", "ul", "ol", "dl", "table", "blockquote", "figure", "details")
        self.of |= {f"tag:{t}": 0.0 for t in neutral}
        whole = log((sum(tags_in.values()) + 1) / (sum(tags_out.values()) + 1))
        self.cost = {t: max(-1.0, min(-0.1, 0.3 * (log((tags_in[t] + 0.5) / (tags_out[t] + 0.5)) - whole))) for t in tags_in | tags_out}

    def container(self, fs: tuple[str, ...]) -> float:
        return sum(self.of.get(f, 0.0) for f in fs)


def _foreign_end(page: str, at: int, name: str) -> int:
    """Where an svg or math element that was opened before ``at`` ends: nested ones are counted, empty ones are not."""
    open_ = 1
    for m in re.compile(f"<(/?){name}(?![\\w:-])([^<>]*)>?", re.I).finditer(page, at):
        if m[1]:
            open_ -= 1
        elif not m[2].rstrip().endswith("/"):
            open_ += 1
        if not open_:
            return m.end()
    return len(page)


def walk(page: str):
    """("tag", (name, attributes, opens), stack) and ("text", text, stack) in page order.

    The stack holds the open containers as (features, hidden). An end tag closes up to its start tag, if that is open.
    """
    at, n = 0, len(page)
    stack: list[tuple[tuple[str, ...], bool]] = []
    names: list[str] = []
    open_names: Counter[str] = Counter()
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if not m[0].startswith("<") or m[0] == "<":
                yield "text", m[0], stack
            continue
        close, attrs, name = m[1] if m[2] else m[4], m[3] if m[2] else m[6], name.lower()
        if close:
            if open_names[name]:
                closed = None
                while closed != name:
                    closed = names.pop()
                    open_names[closed] -= 1
                    stack.pop()
        elif name in RAW:
            if name not in FOREIGN:
                end = re.compile(f"</{name}\\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
            elif not (attrs or "").rstrip().endswith("/"):
                at = _foreign_end(page, at, name)
            yield "tag", (name, "", False), stack
            continue
        elif name in NESTING and not (attrs or "").rstrip().endswith("/"):
            stack.append(features(name, attrs or ""))
            names.append(name)
            open_names[name] += 1
        yield "tag", (name, attrs or "", not close), stack


@lru_cache(1)
def default_weights() -> Weights:
    return Weights(PAGES)


def main_text(page: str | None, weights: Weights | None = None) -> str:
    """The main text of a page; blocks are joined by an empty line. Empty if there is none, or for null."""
    if not page:
        return ""
    w = weights or default_weights()
    # items: (text, or None for the end of a block; content)
    scores: list[float] = []
    items: list[tuple[str | None, bool]] = []
    depth: list[tuple[float, bool, bool]] = [(0.0, False, True)]  # (log-odds, inside marked content, content)
    link = False
    for kind, value, stack in walk(page):
        if len(depth) != len(stack) + 1 or kind == "tag" and value[0] in NESTING:
            del depth[min(len(depth), len(stack)) if kind == "tag" and value[2] else len(stack) + 1 :]
            for fs, hidden in stack[len(depth) - 1 :]:
                total, marked, _ = depth[-1]
                own = w.container(fs[1:] if marked and fs[0] == "tag:header" else fs)  # an article's own headline
                if not MARKED.isdisjoint(fs) and (total >= -1.0 or fs[0] == "tag:main"):  # else one of many comments
                    total, marked, own = max(total, 0.0), True, max(own, 3.0)
                # a container that looks like boilerplate is not made good by what is around it
                total = -9.0 if hidden else own if own < -1.0 else min(total, 0.0) + own if total >= -1.0 else total
                depth.append((total, marked, total >= 0.0))
        total, marked, content = depth[-1]
        if kind == "text":
            words = value.count(" ") + 1 if value.strip() else 0
            plain = content and (marked or not link)
            scores.append(words * (1.0 if plain else 0.0 if marked else LINK if content else -1.0))
            items.append((value, content))
        else:
            name = value[0]
            link = value[2] if name == "a" else link and name not in BLOCKS
            scores.append(0.0 if marked else w.cost.get(name, -0.4))
            items.append((None if name in BLOCKS else " " if name in GAPS else "", content))
    best, lo, hi, run, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0.0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, lo, hi = run, start, i + 1
    blocks, current = [], []
    for text, content in items[lo:hi]:
        if text is None:
            blocks.append(current)
            current = []
        elif content and text:
            current.append(text)
    blocks.append(current)
    # references are decoded once for each text: they cannot reach over a tag
    out = (" ".join("".join(t if t == " " else unescape(t) for t in b).split()) for b in blocks if b)
    return "\n\n".join(b for b in out if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages(page_id, url, html)``.

    Null and empty pages, and pages without any region that scores above zero, have an empty text. Repeated rows and
    null ids are treated like any other; an empty table gives no rows; other columns are not looked at. Every page is
    read as a whole, on its own.
    """

    @F.pandas_udf("string")
    def text_of(html: pd.Series) -> pd.Series:
        w = default_weights()
        return pd.Series([main_text(h, w) for h in html], dtype=object)

    out = pages.select("page_id", "url", text_of(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
