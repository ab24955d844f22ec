"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Blocks of elements that are never main text (menus, forms, footers,
comments, adverts and the like) are boilerplate. The first pass classifies every other block from its share of stop
words, its length and its share of characters in links; in an article, prose needs less to be good, and links are
boilerplate only as a list of several, as headlines and single sentences may be linked. On a page whose language has no
stop words here, length and links decide alone. What stays ambiguous, mostly short blocks, takes in the second pass the
label of the nearest decided block before or after it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

#: Frequent function words of the languages that are recognised.
STOP_WORDS = frozenset(
    """
    the of and to in a is that it for on with as was are be this by at from or an not have has but they which his her
    der die das und ist nicht von zu mit den dem des ein eine auf im für sich auch als an er es wird bei
    le la les de des un une et est que qui dans en pour pas sur au aux du par avec ce se il elle plus
    el los las una y del por con para su al lo como más o pero sus fue ha
    """.split()  # noqa: SIM905
)

#: Thresholds of the first pass (fixed values of the method): share of characters in links, lengths, stop-word shares.
MAX_LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.33, 70, 200, 0.15, 0.30
#: Blocks of links that make a list, and the share of stop words in a page's text below which its language is not known.
LIST_RUN, STOP_KNOWN = 3, 0.04

#: Elements whose content is dropped: of the first, all is plain text up to their end tag; the others may be nested.
PLAIN = frozenset("script style title textarea iframe xmp noembed".split())
DROPPED = PLAIN | frozenset("noscript template svg math object select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var img wbr input link meta source track param embed area base ruby rb rt rp nobr".split()
)
CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())
AWAY_TAGS = frozenset("nav footer aside form menu dialog head".split())
MAIN_TAGS = frozenset("article main".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
AWAY_WORDS = frozenset(
    "ad ads adv adslot adbox adunit adspace adbanner adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notification alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer "
    "comment comments commentlist disqus respond reply replies share sharing social related recommended newsletter subscribe "
    "subscription signup login search masthead topbar toolbar widget skip legal copyright".split()
)
HEADER_WORDS = frozenset("header head topheader".split())
#: Words that say nothing of a name's content; a name such as ``share-buttons`` is boilerplate, ``social-science`` is not.
FRAME_WORDS = frozenset(
    "container box wrapper wrap inner outer block section area bar list item items link links button buttons panel content main left right "
    "top bottom site page global primary secondary mobile desktop title text body row col column grid group module component slot unit zone "
    "space icon icons form field fixed sticky inline float post article entry story the my js is has no new small large big show hide".split()
)
MAIN_IDS = re.compile(r"(?:article|post|entry|story)[-_]?(?:body|content|text)|articlebody", re.I)

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORD_BREAK = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
LETTERS = re.compile(r"[^\W\d_]+")
DROPPED_TAG = re.compile(rf"<(/?)({'|'.join(sorted(DROPPED))})(?=[\s/>])[^>]*>", re.I)


@dataclass
class Block:
    text: str
    linked: int
    region: int | None  # 1 in the article, -1 in boilerplate elements, None elsewhere
    label: str = ""
    run: int = LIST_RUN  # how many blocks of links stand together here, a list where nothing is told of it
    known: bool = True  # whether the page's language has stop words


@dataclass
class _Open:
    tag: str
    region: int | None
    outer: int | None = field(default=None)


def _away(name: str, tag: str, outer: int | None) -> bool:
    """Whether a class, id or property names boilerplate: all its words do or say nothing, and one does."""
    words = {w for w in WORD_BREAK.split(CAMEL.sub("-", name).lower()) if w and not w.isdigit()}
    if words & AWAY_WORDS:
        return words <= AWAY_WORDS | FRAME_WORDS | HEADER_WORDS
    return outer != 1 and tag == "div" and bool(words & HEADER_WORDS) and words <= FRAME_WORDS | HEADER_WORDS


def dropped_ends(page: str) -> dict[int, int]:
    """Where each element whose content is dropped ends, by the place of its start tag; those never closed are left out."""
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    missing: set[str] = set()
    at = 0
    while m := DROPPED_TAG.search(page, at):
        tag, at = m[2].lower(), m.end()
        if m[1]:
            if opened.get(tag):
                found[opened[tag].pop()] = m.end()
        elif tag not in PLAIN:
            opened.setdefault(tag, []).append(m.start())
        elif tag not in missing:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end is None:
                missing.add(tag)
            else:
                found[m.start()] = at = end.end()
    return found


def _region(tag: str, attributes: str, outer: int | None) -> int | None:
    """The region of an element inside ``outer``."""
    if outer == -1:
        return -1
    if tag in AWAY_TAGS or (tag == "header" and outer != 1):
        return -1
    region = 1 if tag in MAIN_TAGS else outer
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return region
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return -1
        if name == "role":
            if value.lower() in AWAY_ROLES:
                return -1
            region = 1 if value.lower() in ("main", "article") else region
        elif name in ("class", "id", "itemprop"):
            if MAIN_IDS.search(value):
                region = 1
                continue
            if tag not in ("body", "html", "article", "main") and any(_away(name, tag, outer) for name in value.split()):
                return -1
    return region


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with the region that each stands in."""
    found: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[_Open] = []
    opened: Counter[str] = Counter()
    region: int | None = None
    in_link, link_depth, dropping = False, 0, False
    ends_at = dropped_ends(page)
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal dropping
        dropping = False
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, len(" ".join(html.unescape(" ".join(linked)).split())), region))
            parts.clear()
            linked.clear()

    def close(tag: str) -> None:
        nonlocal region, in_link
        while stack:
            top = stack.pop()
            opened[top.tag] -= 1
            region = top.outer
            in_link = in_link and len(stack) >= link_depth
            if top.tag == tag:
                return

    def keep(text: str) -> None:
        if text and not dropping:
            parts.append(text)
            if in_link:
                linked.append(text)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            keep(page[at:])
            break
        keep(page[at:lt])
        m = TOKEN.match(page, lt)
        if m is None:
            keep("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                keep(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if tag in DROPPED:
            if not ends and not m[3].endswith("/"):
                # one that is never closed ends where the next block begins
                at, dropping = (ends_at[lt], dropping) if lt in ends_at else (at, True)
            parts.append(" ")
            continue
        if tag == "br":
            keep(" ")
        elif tag == "a":
            in_link, link_depth = not ends, len(stack)
        elif tag in INLINE:
            continue
        else:
            flush()
            if tag in VOID:
                continue
            if ends:
                if opened[tag] > 0:
                    close(tag)
                continue
            if stack and (stack[-1].tag == "p" or stack[-1].tag == tag and tag in CLOSED_BY_SAME):
                close(stack[-1].tag)
            inner = _region(tag, m[3], region)
            stack.append(_Open(tag, inner, region))
            opened[tag] += 1
            region = inner
    flush()
    return found


def words_of(block: Block) -> list[str]:
    return LETTERS.findall(block.text.lower())


def described(found: list[Block]) -> list[Block]:
    """Blocks with what their page tells of them: runs of blocks of links, and whether the language is known."""
    linked = [b.region == 1 and b.linked > MAX_LINKS * len(b.text) for b in found]
    at = 0
    while at < len(found):
        end = at
        while end < len(found) and linked[end]:
            end += 1
        for b in found[at:end]:
            b.run = end - at
        at = max(end, at + 1)
    words = [w for b in found if b.region != -1 for w in words_of(b)]
    known = not words or sum(map(STOP_WORDS.__contains__, words)) >= STOP_KNOWN * len(words)
    for b in found:
        b.known = known
    return found


def first_pass(block: Block) -> str:
    """good, bad, near (ambiguous, rather good) or short (ambiguous)."""
    if block.region == -1:
        return "bad"
    length = len(block.text)
    words = words_of(block)
    stops = sum(map(STOP_WORDS.__contains__, words)) / len(words) if words else 0.0
    if not block.known and words and length >= SHORT:
        stops = STOP_HIGH  # nothing speaks against prose
    inside = block.region == 1
    if block.linked / length > MAX_LINKS:
        return "short" if inside and block.run < LIST_RUN else "bad"
    if length < SHORT:
        if inside:
            return "good" if stops >= STOP_HIGH else "near" if stops >= STOP_LOW else "short"
        return "bad" if block.linked else "short"
    if stops >= (STOP_LOW if inside else STOP_HIGH):
        return "good" if inside or length > LONG else "near"
    if inside:
        return "good" if length > LONG else "near"
    return "near" if stops >= STOP_LOW else "bad"


def classify(found: list[Block]) -> list[Block]:
    """Labels all blocks good or bad.

    An ambiguous block takes the label of the nearest decided one; at equal distances, one that is rather good or stands in
    the article becomes good. A block of the article looks at the article's blocks alone and is good if none is decided;
    for other blocks all beyond the page's edges is bad.
    """
    first = [first_pass(b) for b in found]
    n = len(found)
    for inside in (True, False):
        member = [i for i in range(n) if not inside or found[i].region == 1]
        chosen = {}
        before, after = _decided(member, first), _decided(member[::-1], first)
        for i in member:
            if first[i] in ("good", "bad") or not inside and found[i].region == 1:
                continue
            sides = [(abs(i - k), first[k]) for k in (before[i], after[i]) if k is not None]
            if not inside:
                sides += [(i + 1, "bad")] * (before[i] is None) + [(n - i, "bad")] * (after[i] is None)
            nearest = {label for d, label in sides if d == min(sides)[0]}
            chosen[i] = "bad" if nearest == {"bad"} or "bad" in nearest and first[i] == "short" and not inside else "good"
        for i, label in chosen.items():
            first[i] = label
    for b, label in zip(found, first):
        b.label = label
    return found


def _decided(order: list[int], labels: list[str]) -> dict[int, int | None]:
    """For each block the last one before it in ``order`` that is good or bad."""
    out, last = {}, None
    for i in order:
        out[i] = last
        last = i if labels[i] in ("good", "bad") else last
    return out


def main_text(page: str) -> tuple[str, int, int]:
    """The main text of a page, its number of blocks and how many of them are kept."""
    found = classify(described(blocks(page)))
    kept = [b.text for b in found if b.label == "good"]
    return " ".join(kept), len(found), len(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: ``id_col, url_col, text, n_chars, n_blocks, n_kept``.

    A null or empty page has the text "" (0 characters), as has a page without main text. Character references are
    decoded, white space inside a block becomes one space and blocks are joined by one space. Repeated rows give
    repeated rows, an empty table an empty one; other columns are ignored. Whole pages are read, however long.
    """
    schema = T.StructType(
        [
            *pages.select(id_col, url_col).schema,
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("n_blocks", T.LongType()),
            T.StructField("n_kept", T.LongType()),
        ]
    )

    def make():
        def work(part, texts):
            done = [main_text(t) for t in texts]
            return {
                id_col: part.column(0),
                url_col: part.column(1),
                "text": [t for t, _, _ in done],
                "n_chars": [len(t) for t, _, _ in done],
                "n_blocks": [n for _, n, _ in done],
                "n_kept": [k for _, _, k in done],
            }

        return work

    columns = [id_col, url_col, html_col]
    return map_texts(pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string")), columns, html_col, make, schema)
