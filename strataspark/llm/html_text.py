"""Main text of web pages by line-block distribution.

Markup becomes blocks of text, one for each block element; blocks without text are no blocks. A
block's length is its characters outside links, weighed by its markup: a block inside an
<article> or <main> counts ``THRESHOLD`` characters more, on a page that has one a block outside
counts a ``OUTSIDE``-th, and menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are gaps of no length. Lengths are summed over windows of ``SPAN`` blocks on every
page. Where a window's sum surges above ``THRESHOLD`` text begins, at the window's first heading or
block of its share; where the sum of the next window dives below ``DIVE`` it ends; blocks between are kept.

Null and empty pages, and pages without text, give an empty text. Rows that repeat are extracted each
for itself; other columns of the table are ignored, whatever their names. Unclosed and unmatched
tags, quotes and comments are defined too, and each page takes time linear in its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, THRESHOLD, DIVE, OUTSIDE = 3, 86, 43, 20

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)", re.S)
#: Tags of a page whose quotes don't end, from there on.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|=)")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")

# HTML elements by kind, and the names by which pages call their boilerplate.
_RAW = frozenset("script style noscript template svg iframe textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
_LEFT_OUT = frozenset("nav footer aside form dialog menu button select search".split())
_MARKED = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = frozenset("center dd details dir div dl fieldset figure header hgroup li ol section table tbody td tr ul".split())
_CLOSES_P = _BLOCKS - {"html", "body", "head"}
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comments comment disqus replies reply respond related recommended share sharing social toolbar "
    "pagination pager copyright".split()
)
_NEUTRAL_NAMES = frozenset("area bar block bottom box buttons center container footer global header inner items left links list main page panel right section site slot small top unit widget wrap wrapper".split())


def _boilerplate(token: str) -> bool:
    """Whether a class or id is a known name, or is made of such names and of words that say only where it stands."""
    if token.lower() in _BAD_NAMES:
        return True
    parts = {x.lower() for x in _PARTS.findall(token)}
    return not parts.isdisjoint(_BAD_NAMES) and parts <= _BAD_NAMES | _NEUTRAL_NAMES


def _left_out(name: str, attributes: str, marked: bool) -> bool:
    if name in _LEFT_OUT or name == "header" and not marked:
        return True
    if not attributes or name in _MARKED or name in ("html", "body"):
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id") and name in _CONTAINERS and any(map(_boilerplate, value.split())):
            return True
        value = value.lower()
        if key == "role" and value in _BAD_ROLES or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return bool(_HIDDEN.search(attributes))


class Block(NamedTuple):
    """A block of text; gaps, which stand for what is left out, have none."""

    text: str
    size: int  # characters outside links
    marked: bool  # inside an article
    heading: bool


_GAP = Block("", 0, False, False)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order."""
    blocks: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is left out
    open_names: Counter[str] = Counter()
    open_blocks: list[int] = []  # places of block elements in the stack
    skipping = marked = links = linked = headings = 0
    tag, at, n = _TAG, 0, len(page)

    def end_block() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            blocks.append(Block(text, max(len(text) - linked, 0), bool(marked), bool(headings)))
        parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if skipping:
            if not text.isspace() and (not blocks or blocks[-1] is not _GAP):
                blocks.append(_GAP)
        else:
            parts.append(text)
            if links:
                linked += len(text)

    def push(name: str, out: bool) -> None:
        nonlocal skipping, marked, links, headings
        if out:
            end_block()
        if name in _BLOCKS:
            open_blocks.append(len(stack))
        stack.append((name, out))
        open_names[name] += 1
        skipping += out
        marked += name in _MARKED
        links += name == "a"
        headings += name in _HEADINGS

    def pop() -> None:
        nonlocal skipping, marked, links, headings
        name, out = stack.pop()
        if name in _BLOCKS:
            open_blocks.pop()
        open_names[name] -= 1
        skipping -= out
        marked -= name in _MARKED
        links -= name == "a"
        headings -= name in _HEADINGS

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            take(page[at:])
            break
        if lt > at:
            take(page[at:lt])
        m = tag.match(page, lt)
        if m is None and tag is _TAG and page[lt + 1 : lt + 2].isalpha():
            tag = _LOOSE
            m = tag.match(page, lt)
        if m is None:
            take("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        close, name = m[1], m[2].lower()
        if name in _RAW:
            if not close and not m[3].endswith("/"):
                end = re.compile(f"</{name}", re.I).search(page, at)
                at = n if end is None else max(page.find(">", end.end()) + 1, end.end())
            continue
        if name in _BLOCKS:
            end_block()
        elif name in ("br", "td", "th"):
            take(" ")
        if close:
            if open_names[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name not in _VOID and not m[3].endswith("/"):
            if name in _CLOSES_P and open_blocks and stack[open_blocks[-1]][0] == "p":
                depth = open_blocks[-1]  # an open paragraph ends, with what is open in it
                while len(stack) > depth:
                    pop()
            if name in _MARKED:
                while skipping and not marked:  # an article doesn't stand in a menu: that one wasn't closed
                    pop()
            push(name, _left_out(name, m[3], bool(marked)))
    end_block()
    return blocks


def kept_blocks(blocks: list[Block]) -> list[int]:
    """Places of the blocks between surges and dives; of the longest run of blocks if nothing surges."""
    any_marked = any(b.marked for b in blocks)
    if any_marked:
        sizes = [b.size + THRESHOLD if b.marked else b.size // OUTSIDE for b in blocks]
    else:
        sizes = [b.size for b in blocks]
    sums = [sum(sizes[i : i + SPAN]) for i in range(len(sizes))] + [0]
    kept: list[int] = []
    i = 0
    while i < len(blocks):
        if sums[i] <= THRESHOLD:
            i += 1
            continue
        while SPAN * sizes[i] <= THRESHOLD and not (blocks[i].heading and blocks[i].marked == any_marked):
            i += 1  # the window's sum is above the threshold, so one of its blocks has its share
        kept.append(i)
        while sums[i + 1] >= DIVE:
            i += 1
            kept.append(i)
        i += 1
    if not kept and any(sizes):
        runs: list[list[int]] = [[]]
        for i, size in enumerate(sizes):
            if size:
                runs[-1].append(i)
            elif runs[-1]:
                runs.append([])
        kept = max(runs, key=lambda r: (sum(sizes[i] for i in r), -r[0] if r else 0))
    return [i for i in kept if blocks[i].text]


def main_text(page: str | None) -> str:
    """Blocks of the main text joined by newlines; empty if there is none."""
    blocks = blocks_of(page or "")
    return "\n".join(blocks[i].text for i in kept_blocks(blocks))


def _extract(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages``; null or textless pages give an empty text."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
