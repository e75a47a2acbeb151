"""Raw HTML to text blocks with the features the labelling needs."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

import numpy as np

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>?""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# Element names of HTML by their part in this module.
RAW = frozenset("script style noscript template iframe textarea title".split())
CONTROLS = frozenset("button select".split())
EMBEDDED = frozenset("svg object canvas audio video annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br nobr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mpadded mphantom menclose merror semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ARTICLE, MAIN, APART, HINT_OUT, HINT_IN, HEADING, PARAGRAPH, LIST, FORM, HIDDEN = (1 << i for i in range(10))
BY_TAG = {"article": ARTICLE, "main": MAIN, "nav": APART, "footer": APART, "aside": APART, "menu": APART, "dialog": APART, "form": FORM, "fieldset": FORM, "p": PARAGRAPH, "blockquote": PARAGRAPH, "pre": PARAGRAPH, "li": LIST, "dt": LIST, "dd": LIST}
BY_TAG |= {f"h{i}": HEADING for i in range(1, 7)}
OUT = re.compile(r"ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side|menu\w*|nav\w*|breadcrumbs?|footer|header|masthead|comments?|replies|reply|disqus|cookies?|consent|notice|gdpr|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*|widget|pagination|pager|login|copyright|legal|toolbar|skip", re.I)
#: Of these, what names an element of text as no part of an article.
OUT_TEXT = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter|signup", re.I)
#: Words beside which a name of :data:`OUT` keeps its meaning; beside any other word it may be part of the subject.
BESIDE = re.compile(r"area|author|bar|block|bottom|box|btn|buttons?|card|cards|col|column|container|content|count|fixed|floating|form|grid|group|holder|icons?|inline|inner|items?|left|links?|list|main|message|meta|module|msg|native|outer|page|panel|policy|posts?|primary|region|right|row|secondary|section|settings|site|slot|space|stack|sticky|strip|text|thread|title|toast|tools?|top|unit|wrap|wrapper|zone|\d\w*", re.I)
IN = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|body|text)(?=$|[\s_-])", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ROLES_OUT = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
ROLES_IN = frozenset("main article".split())
FEATURES = ("bias", "article", "main", "apart", "hint_out", "hint_in", "heading", "paragraph", "list", "form", "hidden", "words", "links", "sentence")


class Node:
    """An open block element; shared by all blocks within it."""

    __slots__ = ("parent", "depth")

    def __init__(self, parent: Node | None) -> None:
        self.parent = parent
        self.depth = parent.depth + 1 if parent else 0

    def apart(self, other: Node, most: int = 24) -> int:
        """Steps from one to the other in the element tree, ``most`` if there are more."""
        a, b, steps = self, other, 0
        while a is not b and steps < most:
            if a.depth >= b.depth:
                a = a.parent
            else:
                b = b.parent
            steps += 1
        return steps


@dataclass
class Block:
    text: str
    flags: int
    node: Node
    link_share: float

    def features(self) -> list[float]:
        words = self.text.count(" ") + 1
        return [1.0, *(float(bool(self.flags >> i & 1)) for i in range(10)), min(3.0, np.log1p(words)) - 1.5, self.link_share, float(self.text[-1] in ".!?…:;\"'»”)")]


@dataclass
class _Open:
    tag: str
    flags: int  # of the element and all around it, but for the kind
    kind: int  # heading, paragraph or list: of the nearest element that is one
    in_article: bool
    node: Node
    inline: bool = False


def _named_out(value: str, out: re.Pattern) -> bool:
    """Whether a class or id names boilerplate, and nothing but that."""
    for name in value.split():
        words = [w for w in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", name) if w]
        if any(out.fullmatch(w) for w in words) and all(OUT.fullmatch(w) or BESIDE.fullmatch(w) for w in words):
            return True
    return False


def _flags(tag: str, attrs: str) -> int:
    flags = BY_TAG.get(tag, 0)
    if not attrs or tag in ("html", "body"):
        return flags
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if _named_out(value, OUT_TEXT if flags & (HEADING | PARAGRAPH | LIST) else OUT):
                flags |= HINT_OUT
            elif IN.search(value):
                flags |= HINT_IN
        elif name == "role":
            flags |= APART if value.lower() in ROLES_OUT else MAIN if value.lower() in ROLES_IN else 0
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and UNSEEN.search(value)):
            flags |= HIDDEN
    return flags


def _skipped(html: str, tag: str, at: int) -> int:
    """Where to go on behind the start tag of an element without text of the page.

    An element that isn't closed before it begins again, or a control before a block begins, was left
    open: what follows is read as if the tag weren't there, but for scripts and styles.
    """
    if tag in RAW:
        close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
        return close.end() if close else len(html) if tag in ("script", "style") else at
    stops = rf"</{tag}(?=[\s/>])[^>]*>|<{tag}(?=[\s/>])"
    if tag in CONTROLS:
        stops += rf"|<(?:{'|'.join(sorted(ENDS_P | {'body', 'td', 'tr', 'li'}))})(?=[\s/>])"
    found = re.compile(stops, re.I).search(html, at)
    return found.end() if found and found[0][1] == "/" else at


def blocks(html: str) -> list[Block]:
    """The non-empty text blocks of a page in order.

    Comments, scripts, styles, controls, embedded media and the title give no text; inline elements and
    line breaks don't end a block; elements left open are closed as browsers do; the rest of a page
    after an unclosed comment or script is part of it.
    """
    out: list[Block] = []
    root = Node(None)
    stack: list[_Open] = [_Open("", 0, 0, False, root)]
    open_tags: Counter = Counter()
    parts: list[str] = []
    linked = [0, 0]  # characters within links, and how many links are open

    def flush() -> None:
        if not parts:
            return
        text = " ".join("".join(parts).split())
        parts.clear()
        share = linked[0]
        linked[0] = 0
        if text:
            top = stack[-1]
            out.append(Block(text, top.flags | top.kind, top.node, min(1.0, share / len(text))))

    def push(tag: str, attrs: str, inline: bool) -> None:
        top = stack[-1]
        flags = _flags(tag, attrs)
        kind = flags & (HEADING | PARAGRAPH | LIST) or top.kind
        if tag == "header" and not top.in_article:
            flags |= APART
        open_tags[tag] += 1
        stack.append(_Open(tag, top.flags | flags & ~(HEADING | PARAGRAPH | LIST), kind, top.in_article or tag == "article", top.node if inline else Node(top.node), inline))

    def pop_to(i: int) -> None:
        while len(stack) > i:
            tag = stack.pop().tag
            open_tags[tag] -= 1
            if tag == "a":
                linked[1] -= 1

    at = 0
    end = len(html)
    while at < end:
        m = TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            piece = unescape(html[at:stop])  # references don't reach across tags
            parts.append(piece)
            if linked[1]:
                linked[0] += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag not in INLINE:
                flush()
            if open_tags[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        pop_to(i)
                        break
                    if tag in INLINE and not stack[i].inline:
                        break
            continue
        if tag in RAW or tag in CONTROLS or tag in EMBEDDED:
            if not m[0].endswith("/>") or tag in RAW:
                at = _skipped(html, tag, at)
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag not in VOID:
                if tag == "a":
                    linked[1] += 1
                push(tag, m[3] or m[6] or "", True)
            continue
        flush()
        if tag == "head":
            close = re.compile(r"</head\s*>|<body", re.I).search(html, at)
            at = (close.end() if close[0][1] == "/" else close.start()) if close else at
            continue
        if tag in ENDS_P and open_tags["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if not stack[i].inline:
                    break
        if tag in CLOSES and any(open_tags[t] for t in CLOSES[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    pop_to(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select"):
                    break
        if tag not in VOID:
            push(tag, m[3] or m[6] or "", False)
    flush()
    return out
