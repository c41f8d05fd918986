"""Lenient reading of an HTML page as text blocks with their place in the element tree."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAMES = re.compile(r"[a-zA-Z]+")
_WHITE = re.compile(r"\s+")

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Where an implied end tag does not look further up.
SCOPE = frozenset("ul ol dl table body html article main section div aside nav form select tbody thead tfoot".split())
CHROME_TAGS = frozenset("head nav footer aside form button select textarea menu dialog fieldset".split()) | RAW
#: Words in class, id or role that mark what is not the article. Those of the second set hold readers' or linked text.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus respond replies "
    "widget toolbar search hidden contentinfo complementary dialog pagination pager".split()
)
OTHERS_WORDS = frozenset("comment comments commentlist disqus respond replies related recommended".split())
#: Parts of a name beside such a word that leave its meaning; ``search-result`` or ``content-with-menu`` mark nothing.
NEUTRAL_WORDS = frozenset(
    "area banner bar block bottom box btn button buttons container desktop form global group icon icons inner item items large left link links list "
    "main mobile outer page panel posts primary right row secondary section site slot small sticky thread top unit wrap wrapper".split()
)
#: Elements that hold the article or all of the page: their names describe the page, not them.
WHOLE = frozenset("html body main article".split())
#: A marked element with so much of the page's text is no chrome.
MOST_TEXT = 0.6
HARD = 0


@dataclass
class Block:
    path: str
    chrome: bool
    main: bool
    text: str


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: Opening of each element that is not inline: path -> times.
    elements: dict[str, int] = field(default_factory=dict)


def _names_chrome(value: str) -> tuple[bool, bool]:
    """(a name of the attribute marks chrome, and it is readers' or linked text)."""
    chrome = others = False
    for name in value.split():
        words = {w.lower() for w in _NAMES.findall(name)}
        if words & CHROME_WORDS and words <= CHROME_WORDS | NEUTRAL_WORDS:
            chrome = True
            others |= bool(words & OTHERS_WORDS)
    return chrome, others


def _marks(attrs: str, whole: bool = False) -> tuple[str, bool, bool, bool]:
    """(class name for the path, is chrome for sure, is chrome by a name, is the main part)."""
    name, chrome, named, main = "", False, False, False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            words = {w.lower() for w in _NAMES.findall(value)}
            by_name, others = (False, False) if whole else _names_chrome(value)
            named |= by_name
            chrome |= others
            main |= key == "role" and "main" in words
            if key == "class" and words:
                name = "." + min(words)
        elif key == "itemprop":
            main |= value == "articleBody"
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            chrome = True
    return name, chrome, named, main


def _settle(blocks: list[Block], marks: list[tuple[int, ...]]) -> None:
    """Set ``chrome``: names count unless what they mark holds the page's article or most of its text."""
    open_ = [(b, m) for b, m in zip(blocks, marks, strict=True) if HARD not in m]
    wrong: set[int] = set()
    if not any(b.main and not m for b, m in open_):
        chars: dict[int, int] = {}
        for b, m in open_:
            for n in m:
                chars[n] = chars.get(n, 0) + len(b.text)
                if b.main:
                    wrong.add(n)
        most = MOST_TEXT * sum(len(b.text) for b, _ in open_)
        wrong |= {n for n, c in chars.items() if c >= most}
    for b, m in zip(blocks, marks, strict=True):
        b.chrome = any(n not in wrong for n in m)


def read_page(source: str) -> Page:
    """Blocks of the page in order, each with the path of its element, and how often each path opens.

    Tags need not be closed or nested well: a block element closes an open paragraph, an end tag closes what is still
    open inside its element, and one without a start only ends the block. Text in scripts, styles and the like is
    chrome. Character references are decoded, white space inside a block becomes one space.
    """
    page = Page()
    # (tag, path, marks of chrome around it: HARD or a number for each element named so, main)
    stack: list[tuple[str, str, tuple[int, ...], bool]] = [("", "", (), False)]
    pieces: list[str] = []
    marks: list[tuple[int, ...]] = []
    named_so = HARD

    def flush() -> None:
        if pieces:
            text = _WHITE.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                _, path, chrome, main = next(e for e in reversed(stack) if e[0] not in INLINE)
                page.blocks.append(Block(path, False, main, text))
                marks.append(chrome)

    def take(text: str) -> None:
        # an inline part that is no content leaves a gap in its block
        tag, _, chrome, _ = stack[-1]
        if chrome and tag in INLINE and len(chrome) > len(next(e for e in reversed(stack) if e[0] not in INLINE)[2]):
            text = " "
        pieces.append(text)

    def pop_to(tag: str, until: frozenset[str] = frozenset()) -> bool:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                if tag not in INLINE:
                    flush()
                del stack[i:]
                return True
            if stack[i][0] in until:
                return False
        return False

    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            take(source[at:])
            break
        if m.start() > at:
            take(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag in INLINE:
                pop_to(tag, SCOPE | {"p"})
            elif not pop_to(tag):
                flush()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math"):
            # their content is text up to the end tag, whatever it looks like
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            if tag not in INLINE and tag not in ("script", "style", "svg", "math"):
                flush()
            at = end.end() if end else size
            continue
        if tag in INLINE:
            if tag not in VOID:
                chrome = any(_marks(m["attrs"])[1:3]) if "=" in m["attrs"] or "hidden" in m["attrs"] else False
                top = stack[-1]
                stack.append((tag, top[1], (*top[2], HARD) if chrome else top[2], top[3]))
            continue
        flush()
        if tag in VOID:
            continue
        if any(e[0] == "p" for e in stack[-6:]):
            pop_to("p", SCOPE)
        if tag in CLOSES_ITSELF:
            for sibling in CLOSES_ITSELF[tag]:
                pop_to(sibling, SCOPE)
        name, chrome, named, main = _marks(m["attrs"], tag in WHOLE) if m["attrs"].strip() else ("", False, False, False)
        _, above, above_chrome, above_main = next(e for e in reversed(stack) if e[0] not in INLINE)
        path = f"{above}/{tag}{name}"
        page.elements[path] = page.elements.get(path, 0) + 1
        if tag in CHROME_TAGS or chrome or (tag == "header" and not above_main):
            above_chrome = (*above_chrome, HARD)
        elif named:
            named_so += 1
            above_chrome = (*above_chrome, named_so)
        stack.append((tag, path, above_chrome, above_main or main or tag in ("article", "main")))
    flush()
    _settle(page.blocks, marks)
    return page
