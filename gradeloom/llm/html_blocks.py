"""Leaf blocks of an HTML page and what a sequence model sees of them.

A page is read once, tag by tag, with the implied end tags that matter for blocks. A block
is a run of text between block-level tags; inline tags do not end it. It carries its
ancestors' tags and the words of their ``class``, ``id`` and ``role`` attributes.

Time and memory are linear in the page, whatever its depth: an end tag finds its element by
the places of its name in the stack, a block's ancestors are a chain that blocks share, and
each ancestor sums up what the ones above it say.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property
from html import unescape

# Element classes of HTML.
INLINE = set(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr acronym "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover "
    "munderover mmultiscripts mprescripts mtable mtr mtd menclose semantics annotation annotation-xml".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style template noscript iframe object svg canvas textarea select head title audio video annotation annotation-xml".split())
RAW = ("script", "style", "textarea", "title", "template", "noscript", "iframe")
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr main menu nav ol p pre section table ul".split()
)
IMPLIED = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"},
}
SCOPES = {"ul", "ol", "dl", "table", "select", "menu", "article", "section", "div", "body", "nav", "aside", "main"}

#: What may stand in a page's head; any other start tag ends it, as text does.
IN_HEAD = set("base basefont bgsound link meta title script style noscript template head html".split())
#: Hidden elements that hold tags. One without an end tag ends at the next block.
LOOSE = HIDDEN - set(RAW) - {"head"}
_LOOSE_TAG = re.compile(rf"<(/?)({'|'.join(sorted(LOOSE))})(?=[\s/>])", re.I)

_START = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s<>/]{0,64}+)", re.S
)
_UNQUOTED = re.compile(r"[^<>\"']*+")
_PLAIN_END = re.compile(r"[^<>]*+>")
_RAW_END = re.compile(rf"</({'|'.join(RAW)})\s*>", re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|style|aria-label|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


@dataclass
class Place:
    """An open block-level element, and the chain of those around it."""

    tag: str
    words: frozenset[str]
    above: Place | None

    @cached_property
    def groups(self) -> frozenset[str]:
        """Layout groups of its own words; the whole page's say nothing."""
        return frozenset() if self.tag in ("html", "body") else frozenset(HINT_OF[w] for w in self.words if w in HINT_OF)

    @cached_property
    def summary(self) -> tuple[frozenset[str], frozenset[str], frozenset[str], bool]:
        """What holds for a block in it: features, innermost groups, place in an article, a holder of the main text.

        Worked out after that of the element above; chains are walked from their known part.
        """
        seen, innermost, within, holder = self.above.summary if self.above else _NOWHERE
        names = {f"hint {g}" for g in self.groups}
        if f"in {self.tag}" in INDEX:
            names.add(f"in {self.tag}")
        if self.tag in ("article", "main"):
            within = frozenset({"article"})
        elif self.tag not in ("html", "body"):
            if within:
                if self.groups - {"main", "meta", "head"} or self.tag in ("nav", "aside", "footer", "form"):
                    within |= {"boiler in article"}
                elif self.tag == "header":
                    within |= {"head in article"}
        if self.tag not in ("html", "body") and "hidden" in self.words:
            names.add("hidden")
        holder = holder or self.tag in ("article", "main") or self.tag != "body" and "main" in {
            HINT_OF.get(w) for w in self.words
        }
        return seen if names <= seen else seen | names, self.groups or innermost, within, holder


_NOWHERE: tuple[frozenset[str], frozenset[str], frozenset[str], bool] = (frozenset(), frozenset(), frozenset(), False)


@dataclass
class Block:
    text: str
    #: The innermost open block-level element.
    place: Place | None
    link_chars: int = 0

    @property
    def path(self) -> list[tuple[str, frozenset[str]]]:
        """Open block-level elements from the outermost to the innermost: tag and attribute words."""
        found, place = [], self.place
        while place:
            found.append((place.tag, place.words))
            place = place.above
        return found[::-1]


def _words(attributes: str) -> frozenset[str]:
    found = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() == "hidden" or name.lower() == "style" and re.search(r"display\s*:\s*none", value):
            found.add("hidden")
        elif name.lower() != "style":
            found.update(w.lower() for w in _WORD.findall(value))
    return frozenset(found)


def _unclosed(html: str) -> set[int]:
    """Where elements of ``LOOSE`` start that have no end tag of their own."""
    waiting: dict[str, list[int]] = {name: [] for name in LOOSE}
    for match in _LOOSE_TAG.finditer(html):
        starts = waiting[match[2].lower()]
        if not match[1]:
            starts.append(match.start())
        elif starts:
            starts.pop()
    return {at for starts in waiting.values() for at in starts}


class _Tags:
    """Where the tags of a page end."""

    def __init__(self, html: str):
        self.html = html
        #: For each quote the place from which on there is none.
        self.none_from = {'"': len(html), "'": len(html)}

    def end(self, at: int) -> int:
        """After the tag whose name ends at ``at``; -1 where none ends, and the text is no tag.

        Quoted values go to their closing quote. A tag whose quotes do not close, or that
        holds "<" outside of them, ends at the next ">" before any "<". However the quotes
        of a page lie, at most three tries read the same character, as each quote swaps two
        of the three states that a try can be in.
        """
        html, here = self.html, at
        while True:
            here = _UNQUOTED.match(html, here).end()
            mark = html[here:here + 1]
            if mark == ">":
                return here + 1
            if mark not in self.none_from or here + 1 >= self.none_from[mark]:
                break
            close = html.find(mark, here + 1)
            if close < 0:
                self.none_from[mark] = here + 1
                break
            here = close + 1
        plain = _PLAIN_END.match(html, at)
        return plain.end() if plain else -1


def _raw_ends(html: str) -> dict[str, tuple[list[int], list[int]]]:
    """For each name of ``RAW`` where its end tags start and end."""
    ends: dict[str, tuple[list[int], list[int]]] = {name: ([], []) for name in RAW}
    for match in _RAW_END.finditer(html):
        starts, stops = ends[match[1].lower()]
        starts.append(match.start())
        stops.append(match.end())
    return ends


def blocks(html: str) -> list[Block]:
    """The blocks with text, in page order."""
    out: list[Block] = []
    stack: list[str] = []
    pieces: list[str] = []
    linked = 0
    #: Where in the stack each name is, and where the block-level elements are.
    where: defaultdict[str, list[int]] = defaultdict(list)
    outer: list[int] = []
    place: Place | None = None
    hidden = 0
    #: Where in the stack unclosed hidden elements are.
    loose: list[int] = []
    unclosed = _unclosed(html)
    raw_ends = _raw_ends(html)
    tags = _Tags(html)

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            out.append(Block(text, place, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal hidden, place
        if outer and outer[-1] >= upto:
            flush()
        for tag in reversed(stack[upto:]):
            where[tag].pop()
            hidden -= tag in HIDDEN
            if tag not in INLINE:
                outer.pop()
                place = place.above
        del stack[upto:]
        while loose and loose[-1] >= upto:
            loose.pop()

    def last(names: set[str]) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    at, look, end = 0, 0, len(html)
    while at < end:
        match = _START.search(html, look)
        after = match.end() if match else end
        if match and match[2] is not None:
            after = tags.end(match.end())
            if after < 0:
                look = match.end()
                continue
        stop = match.start() if match else end
        if stack and stack[-1] == "head" and html[at:stop].strip():
            close(len(stack) - 1)
        if stop > at and not hidden:
            raw = html[at:stop]
            pieces.append(raw)
            if where["a"]:
                linked += len(raw.strip())
        if not match:
            break
        at = look = after
        closing, name = match.groups()
        if name is None:
            continue
        attributes = html[match.end():after - 1]
        name = name.lower()
        if closing:
            if where.get(name):
                close(where[name][-1])
            elif name not in INLINE:
                flush()
            continue
        if where["head"] and name not in IN_HEAD:
            close(where["head"][0])
        if loose and (name in CLOSES_P or name in IMPLIED and name != "option" or name == "body"):
            close(loose[0])
        if name == "br":
            pieces.append(" ")
            continue
        if name in CLOSES_P and outer and stack[outer[-1]] == "p":
            close(outer[-1])
        if name in IMPLIED:
            implied = last(IMPLIED[name])
            if implied > last(SCOPES):
                close(implied)
        if name not in INLINE:
            flush()
        if name in VOID or attributes.endswith("/") and name not in RAW:
            continue
        if name in RAW:
            starts, stops = raw_ends[name]
            over = bisect_left(starts, at)
            at = look = stops[over] if over < len(stops) else (end if name in ("script", "style") else at)
            continue
        if match.start() in unclosed:
            loose.append(len(stack))
        if name not in INLINE:
            place = Place(name, _words(attributes), place)
            # Known before the next one is opened, so no chain is ever walked.
            place.summary  # noqa: B018
            outer.append(len(stack))
        where[name].append(len(stack))
        stack.append(name)
        hidden += name in HIDDEN
    flush()
    return out


# Words that pages use for the parts of a layout.
HINTS = {
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc skip tabs",
    "foot": "footer foot bottom copyright legal colophon imprint",
    "head": "header masthead banner topbar logo brand site branding",
    "side": "sidebar side aside widget widgets related recommended recommend trending popular more rail teaser promo",
    "talk": "comment comments commentlist reply replies discussion disqus respond response responses reader feedback thread",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promotion promoted adsense outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay privacy paywall warning dialog toast",
    "form": "newsletter subscribe subscription signup login search form contact register",
    "share": "share sharing social follow tweet facebook buttons toolbar",
    "main": "article content main post entry story body text prose page",
    "meta": "author byline meta date published tags tag category credit",
}
HINT_OF = {word: group for group, words in HINTS.items() for word in words.split()}
TAGS = (
    "article main section nav header footer aside form li table td figure figcaption blockquote pre "
    "h1 h2 h3 h4 p div button label address dd dt details dialog ul ol fieldset menu legend"
).split()

NAMES = [
    "one",
    *(f"in {t}" for t in TAGS), *(f"leaf {t}" for t in TAGS),
    *(f"hint {h}" for h in HINTS), *(f"near hint {h}" for h in HINTS), *(f"inner {h}" for h in HINTS), "hidden",
    "boiler in article", "head in article",
    *(f"words {i}" for i in range(7)), "no link", "some link", "mostly link", "ends sentence",
    "has comma", "copyright", "first", "last", "early", "late", "after article", "before article", "outside article",
]
INDEX = {name: i for i, name in enumerate(NAMES)}
_STEPS = (2, 5, 10, 20, 40, 80)


def described(found: list[Block]) -> list[list[int]]:
    """For each block the numbers of the features that hold."""
    n = len(found)
    nowhere = Place("", frozenset(), None)
    places = [b.place or nowhere for b in found]
    holders = [i for i, place in enumerate(places) if place.summary[3]]
    low, high = (holders[0], holders[-1]) if holders else (n, -1)
    inside = set(holders)
    out = []
    for i, (block, place) in enumerate(zip(found, places, strict=True)):
        seen, innermost, within, _ = place.summary
        names = {"one", *seen, *(within - {"article"})}
        if f"leaf {place.tag}" in INDEX:
            names.add(f"leaf {place.tag}")
        near = place.groups | (place.above.groups if place.above else frozenset())
        names.update(f"near hint {g}" for g in near)
        names.update(f"inner {g}" for g in innermost)
        words = block.text.split()
        names.add(f"words {sum(len(words) > s for s in _STEPS)}")
        share = block.link_chars / len(block.text)
        names.add("no link" if share == 0 else "some link" if share < 0.5 else "mostly link")
        if block.text[-1] in ".!?…\"”»":
            names.add("ends sentence")
        if "," in block.text:
            names.add("has comma")
        if "©" in block.text or "all rights reserved" in block.text.lower():
            names.add("copyright")
        if i == 0:
            names.add("first")
        if i == n - 1:
            names.add("last")
        names.add("early" if i < n / 2 else "late")
        if i not in inside and holders:
            names.add("outside article")
            names.add("before article" if i < low else "after article" if i > high else "early")
        out.append(sorted(INDEX[x] for x in names))
    return out
