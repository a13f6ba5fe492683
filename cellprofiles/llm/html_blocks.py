"""Leaf blocks of a web page: their text, the path of elements above them, and some counts."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

#: Elements that start and end a block (fixed values: the block elements of HTML).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li "
    "main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)

#: Elements without content, and elements whose content is never text of the page.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
HIDDEN_TAGS = frozenset(
    "canvas iframe head noscript object script select style svg template textarea title".split()
)

#: Hidden elements that go on to the end of the page if they are not closed, as in browsers.
RAW_TAGS = frozenset("script style textarea title".split())

#: Elements that an element of the same row ends if it is open.
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tr": {"tr", "td", "th"},
    "option": {"option"},
}
_SCOPES = frozenset("ul ol dl table div section article main body".split())

_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: Attributes up to a quoted value or the end of the tag; quotes count as such behind ``=`` only.
_ATTRIBUTES = re.compile(r"(?:[^>=]++|=\s*+(?![\"'])[^\s>]*+)*+")
_QUOTE = re.compile(r"=\s*([\"'])")

#: Where an unclosed head ends, and where another unclosed hidden element does; an option is part
#: of its select.
_STARTS = "|".join(sorted(BLOCK_TAGS - {"option"}))
_HEAD_PART = re.compile(
    rf"(?P<comment><!--)|<(?P<part>script|style|title|noscript|template)(?=[\s/>])"
    rf"|(?P<end></head\b[^>]*(?:>|\Z))|(?P<body><(?:body|{_STARTS})(?=[\s/>]))",
    re.I,
)
_HEAD_EDGE = re.compile(r"</?head\b|<body\b", re.I)
_RESUME = re.compile(rf"<(?:/?(?:{_STARTS})|/body|/html)(?=[\s/>])", re.I)
_NAMES = re.compile(r"\b(class|id|role|data-keep)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_LETTERS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

def bucket(token: str, buckets: int) -> int:
    """A bucket of a token, from 1; 0 is for nothing."""
    return 1 + zlib.crc32(token.encode("utf-8", "surrogatepass")) % (buckets - 1)


class Path:
    """The names of an element and of all elements above it.

    Paths of a page share what is above, so deep pages need no more room than flat ones.
    ``fresh`` are those of its own ``names`` that no element above has; ``total`` is room for what
    a labeller sums up along the path.
    """

    __slots__ = ("above", "names", "fresh", "total")

    def __init__(self, above: Path | None, names: tuple[str, ...], fresh: tuple[str, ...]):
        self.above, self.names, self.fresh, self.total = above, names, fresh, None

    def last(self, count: int) -> tuple[str, ...]:
        """The innermost names."""
        found, at = (), self
        while at is not None and len(found) < count:
            found, at = at.names[len(found) - count :] + found, at.above
        return found

    def different(self) -> tuple[str, ...]:
        """Every name once, outermost first."""
        parts, at = [], self
        while at is not None:
            parts.append(at.fresh)
            at = at.above
        return tuple(name for part in reversed(parts) for name in part)


ROOT = Path(None, (), ())


@dataclass
class Block:
    text: str
    path: Path
    link_chars: int
    keep: bool = False  # only in pages for training


@dataclass
class _Open:
    tag: str
    path: Path
    keep: bool


@dataclass
class _Parser:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    places: defaultdict[str, list[int]] = field(default_factory=lambda: defaultdict(list))
    names: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    links: int = 0

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)
            if self.places["a"]:
                self.links += len(raw.strip())

    def flush(self) -> None:
        if not self.parts:
            return
        text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
        if text:
            path, keep = (self.stack[-1].path, self.stack[-1].keep) if self.stack else (ROOT, False)
            self.blocks.append(Block(text, path, min(self.links, len(text)), keep))
        self.parts, self.links = [], 0

    def innermost(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of ``tags``, -1 if none is open."""
        return max((self.places[tag][-1] for tag in tags if self.places[tag]), default=-1)

    def close(self, place: int) -> None:
        """End the open element at a place and all inside it."""
        while len(self.stack) > place:
            gone = self.stack.pop()
            self.places[gone.tag].pop()
            self.names.subtract(set(gone.path.names))

    def open_tag(self, tag: str, attributes: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
            if self.places["p"]:
                self.close(self.places["p"][-1])
            ends = ENDS.get(tag)
            if ends and (place := self.innermost(ends)) > self.innermost(_SCOPES):
                self.close(place)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID_TAGS:
            return
        above = self.stack[-1] if self.stack else _Open("", ROOT, False)
        names, keep = [tag], above.keep
        for name, *values in _NAMES.findall(attributes) if attributes else ():
            value = "".join(values)
            if name.lower() == "data-keep":
                keep = value == "1"
            else:
                words = _LETTERS.findall(_CAMEL.sub(" ", value).lower())
                names += [f".{word}" for word in words]
        own = dict.fromkeys(names)
        fresh = tuple(name for name in own if not self.names[name])
        self.names.update(own.keys())
        self.places[tag].append(len(self.stack))
        self.stack.append(_Open(tag, Path(above.path, tuple(names), fresh), keep))

    def close_tag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        if self.places[tag]:
            self.close(self.places[tag][-1])


class _Tags:
    """Tags of a page from growing positions on, in time that grows with the page alone.

    A quoted value may have any length. A tag with a quote that is never closed ends at its first
    ``>``; ``lost`` are the places of quotes from which on no tag can end otherwise.
    """

    def __init__(self, page: str):
        self.page, self.last, self.lost = page, page.rfind(">"), set()

    def end(self, at: int) -> int:
        """The ``>`` that ends the tag whose attributes start at ``at``, -1 if there is none."""
        if at > self.last:
            return -1
        seen, place = [], _ATTRIBUTES.match(self.page, at).end()
        while not self.page.startswith(">", place):
            quote = _QUOTE.match(self.page, place)
            if not quote or quote.end() in self.lost:
                break
            seen.append(quote.end())
            close = self.page.find(quote[1], quote.end())
            if close < 0:
                break
            place = _ATTRIBUTES.match(self.page, close + 1).end()
        else:
            return place
        self.lost.update(seen)
        return self.page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start, end, ``/`` of an end tag, name and attributes of the next tag; comments and
        declarations have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith(("<!", "<?"), start):
                mark, skip = ("-->", 4) if page.startswith("<!--", start) else (">", 2)
                end = page.find(mark, start + skip)
                return start, len(page) if end < 0 else end + len(mark), "", "", ""
            name = _TAG_NAME.match(page, start)
            end = self.end(name.end()) if name else -1
            if end >= 0:
                return start, end + 1, name[1], name[2].lower(), page[name.end() : end]
            at = start + 1
        return None


class _Ahead:
    """The next match of a pattern from growing positions on; no stretch is searched twice."""

    def __init__(self, pattern: str, page: str):
        self.pattern, self.page = re.compile(pattern, re.I), page
        self.found: re.Match | None = self.pattern.search(page)

    def after(self, at: int) -> re.Match | None:
        if self.found and self.found.start() < at:
            self.found = self.pattern.search(self.page, at)
        return self.found


def _ends(page: str, tag: str) -> dict[int, int]:
    """Start of each closed element of a tag, and the end of its end tag."""
    found, opened = {}, []
    for mark in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*(?:>|\Z)", page, re.I):
        if not mark[1]:
            if not mark[0].endswith("/>"):
                opened.append(mark.start())
        elif opened:
            found[opened.pop()] = mark.end()
    return found


class _Hidden:
    """Where a page goes on after its hidden elements."""

    def __init__(self, page: str):
        self.page = page
        self.ends: dict[str, dict[int, int]] = {}
        self.ahead: dict[str, _Ahead] = {}

    def next(self, pattern: str, at: int) -> re.Match | None:
        if pattern not in self.ahead:
            self.ahead[pattern] = _Ahead(pattern, self.page)
        return self.ahead[pattern].after(at)

    def end_tag(self, tag: str, at: int) -> re.Match | None:
        return self.next(rf"</{tag}\b[^>]*(?:>|\Z)", at)

    def after_head(self, at: int) -> int:
        page = self.page
        while part := _HEAD_PART.search(page, at):
            if part["end"]:
                return part.end()
            if part["body"]:
                return part.start()
            if part["comment"]:
                end = page.find("-->", part.end())
                at = len(page) if end < 0 else end + 3
                continue
            tag, at = part["part"].lower(), page.find(">", part.end()) + 1
            if not at:
                break
            end = self.end_tag(tag, at)
            if tag in RAW_TAGS:
                at = end.end() if end else len(page)
            elif end:
                edge = self.next(_HEAD_EDGE.pattern, at)
                if not edge or end.start() < edge.start():
                    at = end.end()
        return len(page)

    def after(self, tag: str, start: int, at: int) -> int:
        """Where the page goes on after the element that starts at ``start``; ``at`` is the end of
        its start tag."""
        if tag in RAW_TAGS:
            end = self.end_tag(tag, at)
            return end.end() if end else len(self.page)
        if tag == "head":
            return self.after_head(at)
        if tag not in self.ends:
            self.ends[tag] = _ends(self.page, tag)
        if start in self.ends[tag]:
            return self.ends[tag][start]
        resume = _RESUME.search(self.page, at)
        return resume.start() if resume else len(self.page)


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks of text in page order; white space is one space, references are decoded.

    Comments, scripts, styles, the head and the like are no text. ``<br>`` is white space.
    Unclosed and misplaced tags are put up with; a page without tags is one block. An unclosed
    script, style, textarea or title hides the rest of the page, as in browsers; other unclosed
    hidden elements end at the next block start or end. Time grows with the length of the page,
    whatever is in it; paths, classes and attributes are taken whole.
    """
    if not page:
        return []
    parser, tags, hidden, at = _Parser(), _Tags(page), _Hidden(page), 0
    while at < len(page):
        found = tags.next(at)
        if not found:
            rest = page[at:]
            cut = rest.rfind("<")  # a tag that the end of the page cuts off
            cut_off = cut >= 0 and re.match(r"</?[a-zA-Z!]", rest[cut : cut + 2] + "a")
            parser.text(rest[:cut] if cut_off else rest)
            break
        start, end, closing, tag, attributes = found
        parser.text(page[at:start])
        at = end
        if closing:
            parser.close_tag(tag)
        elif tag in HIDDEN_TAGS:
            if not attributes.endswith("/"):
                at = hidden.after(tag, start, at)
        elif tag:
            parser.open_tag(tag, attributes)
    parser.flush()
    return parser.blocks
