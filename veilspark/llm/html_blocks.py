"""HTML as a sequence of text blocks, each with the path of tags above it. Forgiving: never fails on broken markup."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

#: Elements whose content is no text, those of them that reach to the end of the page if they are left open, elements that
#: stand alone, and elements that don't end a block (fixed values of HTML).
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "object", "select")
TO_THE_END = frozenset(("script", "style", "textarea", "title"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup svg time tt u var wbr math maction menclose merror mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation".split())
#: An open element that a new one of the same group closes (a <p> left open ends at the next block).
CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
NAMED = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Block:
    text: str
    #: names on the path, outermost first: tags, and the words of class, id and role with a dot before them
    path: tuple[str, ...]
    linked: int  # characters inside links
    hidden: bool


def names_of(tag: str, attrs: str) -> tuple[str, ...]:
    words = (w.lower() for m in NAMED.finditer(attrs) for w in PARTS.findall(m[1] or m[2] or m[3] or ""))
    return (tag, *("." + w for w in words))


def is_hidden_by(attrs: str) -> bool:
    """Whether the attributes hide their element: hidden, aria-hidden="true" or a style with display:none; by name, so that no class or other value does."""
    low = attrs.lower()
    if "hidden" not in low and "display" not in low:
        return False
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if name == "hidden" and value not in ("until-found", "false") or name == "aria-hidden" and value == "true" or name == "style" and NOT_SHOWN.search(value):
            return True
    return False


def tokens(html: str) -> Iterator[re.Match]:
    """The matches of TOKEN one after another, without raw elements. A raw element left open is a tag like others, but for TO_THE_END."""
    at, left_open = 0, set()
    while at < len(html):
        m = TOKEN.match(html, at)
        at = m.end()
        name = (m["tag"] or "").lower()
        if name in RAW_END and not m["close"] and not (name == "svg" and m["attrs"].rstrip().endswith("/")):
            # What isn't closed from here on isn't closed further on either, so the page is searched once for it.
            end = None if name in left_open else RAW_END[name].search(html, at)
            if end:
                at = end.end()
                continue
            if name in TO_THE_END:
                return
            left_open.add(name)
        yield m


def blocks(html: str | None) -> list[Block]:
    """The page's text blocks in order. White space inside a block is one space, character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    path: tuple[str, ...] = ()
    parts: list[tuple[str, bool]] = []
    links = hidden = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(unescape("".join(p for p, _ in parts)).split())
            if text:
                out.append(Block(text, path, sum(len(p) for p, linked in parts if linked), hidden > 0))
            parts = []

    def pop(n: int) -> None:
        """Close the elements from the n-th on."""
        nonlocal path, links, hidden
        for tag, _, is_hidden in stack[n:]:
            links -= tag == "a"
            hidden -= is_hidden
        del stack[n:]
        path = tuple(x for _, names, _ in stack for x in names)

    for m in tokens(html or ""):
        text = m["text"]
        if text is not None:
            parts.append((text, links > 0))
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is None or tag in INLINE and any(t not in INLINE for t, _, _ in stack[at:]):
                continue  # closes nothing that is open here
            if tag not in INLINE:
                flush()
            pop(at)
            continue
        attrs = m["attrs"]
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag not in INLINE:
            flush()
            shut = CLOSES.get(tag, ()) + (("p",) if tag in ENDS_P else ())
            # Only what is open since the last other block-level element.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    pop(i)
                    break
                if stack[i][0] not in INLINE:
                    break
            first = next((i for i, (t, _, _) in enumerate(stack) if t in INLINE), None)
            if first is not None and all(t in INLINE for t, _, _ in stack[first:]):
                pop(first)  # an inline element left open doesn't reach over blocks
        if attrs.rstrip().endswith("/"):
            continue
        is_hidden = is_hidden_by(attrs)
        names = names_of(tag, attrs) if attrs else (tag,)
        stack.append((tag, names, is_hidden))
        links += tag == "a"
        hidden += is_hidden
        if tag not in INLINE:
            path = path + names
    flush()
    return out
