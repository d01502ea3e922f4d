"""A small reader of HTML: the elements of a page with their places in the source, and the text blocks of its article."""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

# Element names of the HTML standard by role, and words that name page furniture in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object canvas xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("aside button dialog footer form head input label menu nav select option datalist audio video map".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription sidebar aside nav navbar navigation menu breadcrumb breadcrumbs header masthead footer comment comments disqus"
    " respond replies share sharing social related recommended pagination pager widget login signup search skip toolbar contentinfo complementary".split()
)
CLOSES_ITSELF = {"li": "ul ol menu dir", "dt": "dl", "dd": "dl", "tr": "table", "td": "table", "th": "table", "option": "select"}
CELLS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[\"'>]")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
_TELLING = re.compile("class|id|role|hidden|style", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


_CONTAINER_WORD = re.compile(r"[^\W\d_]+")


@dataclass(slots=True)
class Element:
    tag: str
    start: int
    parent: Element | None
    furniture: bool
    inside: bool  # within an article or main element
    nested: bool  # within an element of the same name that is not furniture
    skeleton: int  # hash of the names on the way from the root, with classes and id without digits
    depth: int
    attributes: str = ""
    end: int = -1
    parts: list = field(default_factory=list)  # text pieces and child elements
    chars: int = 0  # of text, white space aside
    links: int = 0  # of those, within links
    content: bytes = b""  # hash of all it holds


def _is_furniture(tag: str, attributes: str, inside: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not inside):
        return True
    if not attributes or not _TELLING.search(attributes):
        return False
    if _HIDDEN.search(attributes):
        return True
    if tag in ("html", "body", "main"):
        return False
    found = " ".join(m[1] for m in _NAMES.finditer(attributes))
    if not found:
        return False
    words = {w.lower() for w in _WORD.findall(_CAMEL.sub(" ", found))}
    if tag == "article":
        return not words.isdisjoint(("comment", "comments", "ad", "advert"))
    if tag in HEADINGS:
        words -= {"header", "banner"}
    return not words.isdisjoint(FURNITURE_WORDS)


def _tag_end(source: str, at: int, quoted: bool) -> int:
    """Place of the ``>`` that ends a tag, quotes respected if ``quoted``; -1 without one."""
    while quoted:
        stop = _STOP.search(source, at)
        if stop is None:
            return -1
        if stop[0] == ">":
            return stop.start()
        at = source.find(stop[0], stop.end()) + 1
        if not at:
            return -1
    return source.find(">", at)


def tokens(source: str):
    """``(text, closing, tag, attributes, start, end)``: a text piece and the tag after it, the last with no tag.

    One pass: comments, tags and raw elements are jumped over.  Where quotes are not closed before the end of the page, they
    are taken as letters from there on, so no part of a page is searched twice for them.
    """
    at = begin = 0
    quoted, size = True, len(source)
    while True:
        at = source.find("<", at)
        if at < 0:
            break
        start, closing = at, source.startswith("/", at + 1)
        name = _NAME.match(source, at + 1 + closing)
        if name is None:
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                end = size if end < 0 else end + 3
            elif source[at + 1 : at + 2] in ("!", "?", "/") and at + 1 < size:
                end = source.find(">", at) + 1
                if not end:
                    break  # no tag ends any more
            else:
                at += 1
                continue
            yield source[begin:start], False, "", "", start, end
            at = begin = end
            continue
        end = _tag_end(source, name.end(), quoted)
        if end < 0 and quoted:
            quoted = False
            end = _tag_end(source, name.end(), False)
        if end < 0:
            break
        tag = name[0].lower()
        yield source[begin:start], closing, tag, source[name.end() : end], start, end + 1
        at = begin = end + 1
        if tag in RAW and not closing:
            close = _raw_end(tag).search(source, at)
            end = source.find(">", close.end()) + 1 if close else 0
            at = begin = end or size
            yield "", True, tag, "", start, at
    yield source[begin:], False, "", "", size, size


@lru_cache(maxsize=None)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


def _place(parent: int, tag: str, attributes: str) -> int:
    return _key(parent, tag, attributes if attributes and _TELLING.search(attributes) else "")


@lru_cache(maxsize=1 << 16)
def _key(parent: int, tag: str, attributes: str) -> int:
    names = sorted({w.lower() for m in _NAMES.finditer(attributes) for w in _CONTAINER_WORD.findall(m[1])}) if attributes else []
    return int.from_bytes(hashlib.blake2b(f"{parent} {tag} {names}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def read(source: str) -> Element:
    """The tree of a page.  Missing end tags are supplied as browsers do for paragraphs, items and cells.

    Work is linear in the page: the open elements of each name are known by their depth, so none is looked for.
    """
    root = Element("", 0, None, False, False, False, 0, 0)
    open_, depths, blocks, real = [root], {}, [0], {"article": 0, "main": 0}

    def last(tag: str) -> int:
        return depths[tag][-1] if depths.get(tag) else -1

    def close(depth: int, outer: int, inner: int) -> None:
        """Close the element at ``depth`` and all in it."""
        while len(open_) > depth:
            node = open_.pop()
            node.end = outer if len(open_) == depth else inner
            depths[node.tag].pop()
            if node.tag in BLOCK:
                blocks.pop()
            if node.tag in real and not node.furniture:
                real[node.tag] -= 1
            _finish(source, node)

    for text, closing, tag, attributes, start, end in tokens(source):
        if text:
            open_[-1].parts.append(text)
        if not tag:
            continue
        if closing:
            depth = last(tag)
            if depth > (0 if tag in BLOCK else blocks[-1]):
                close(depth, end, start)
            continue
        if tag in BLOCK and open_[blocks[-1]].tag == "p":
            close(blocks[-1], start, start)
        if tag in CLOSES_ITSELF:
            depth = max(last(t) for t in CELLS.get(tag, (tag,)))
            if depth > max(last(t) for t in CLOSES_ITSELF[tag].split()) and depth > 0:
                close(depth, start, start)
        up = open_[-1]
        inside = up.inside or up.tag in ("article", "main")
        furniture = up.furniture or _is_furniture(tag, attributes, inside)
        node = Element(tag, start, up, furniture, inside, real.get(tag, 0) > 0, _place(up.skeleton, tag, attributes), len(open_), attributes, end)
        up.parts.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            depths.setdefault(tag, []).append(len(open_))
            if tag in BLOCK:
                blocks.append(len(open_))
            if tag in real and not furniture:
                real[tag] += 1
            open_.append(node)
        else:
            _finish(source, node)
    close(1, len(source), len(source))
    root.end = len(source)
    _finish(source, root)
    return root


def _finish(source: str, node: Element) -> None:
    """Sums and content hash of a closed element, from its pieces and the hashes of its children."""
    digest = hashlib.blake2b(f"{node.tag} {' '.join(node.attributes.split())}".encode("utf-8", "surrogatepass"), digest_size=8)
    for part in node.parts if node.tag not in RAW else ():
        if isinstance(part, str):
            words = part.split()
            digest.update((" ".join(words) + "\0").encode("utf-8", "surrogatepass"))
            size = sum(map(len, words))
            node.chars += size
            node.links += size if node.tag == "a" else 0
        else:
            digest.update(part.content)
            node.chars += part.chars
            node.links += part.chars if node.tag == "a" else part.links
    node.content = digest.digest()


def walk(node: Element):
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(p for p in reversed(node.parts) if not isinstance(p, str))


def subtree_hash(node: Element) -> int:
    return int.from_bytes(node.content, "little", signed=True)


def may_be_template(node: Element) -> bool:
    """Containers, and lines that stand in the page itself.  Paragraphs, headings and items of an article are its own text, however
    often a site repeats them."""
    if node.tag not in BLOCK or node.tag in ("html", "body", "article", "main"):
        return False
    return node.tag not in _OWN or node.parent.tag in ("", "html", "body")


_OWN = HEADINGS | {"p", "li", "blockquote", "pre", "dd", "dt", "td", "th", "tr", "figcaption", "tbody", "thead", "tfoot"}


def is_container(node: Element) -> bool:
    """Elements that lay out a page, rather than lines of text."""
    return node.tag in BLOCK and node.tag not in _OWN


@dataclass(frozen=True)
class Templates:
    """What a host repeats on a page: content hashes, and skeletons that go everywhere or only outside the main region."""

    contents: frozenset = frozenset()
    anywhere: frozenset = frozenset()
    outside: frozenset = frozenset()
    main: frozenset = frozenset()


def _template_parts(root: Element, templates: Templates) -> set[int]:
    gone: set[int] = set()
    stack = [(root, False)]
    while stack:
        node, within = stack.pop()
        if may_be_template(node) and subtree_hash(node) in templates.contents:
            gone.add(id(node))
        elif is_container(node) and node.skeleton not in templates.main:
            if node.skeleton in templates.anywhere and not node.inside or node.skeleton in templates.outside and not within:
                gone.add(id(node))
        within = within or node.skeleton in templates.main
        stack.extend((p, within) for p in node.parts if not isinstance(p, str))
    return gone


def _roots(root: Element) -> tuple[str, list[Element]]:
    """The page's articles, else its ``main`` elements, else all of it."""
    for tag in ("article", "main"):
        found = [n for n in walk(root) if n.tag == tag and not n.furniture and not n.nested]
        if found:
            return tag, found
    return "page", [root]


def _blocks(tops: list[Element], gone: set[int], marks: bool) -> list[str]:
    blocks: list[str] = []
    line: list[str] = []

    def flush():
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    for top in tops:
        flush()
        stack: list = [top]
        while stack:
            part = stack.pop()
            if part is None:
                flush()
            elif isinstance(part, str):
                line.append(part)
            elif id(part) in gone or (part.furniture if marks else part.tag in RAW):
                if part.tag in BLOCK:
                    flush()
            elif part.tag == "br":
                line.append(" ")
            else:
                if part.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(part.parts))
    flush()
    return blocks


def article_blocks(root: Element, templates: Templates = Templates()) -> tuple[list[str], str]:
    """Text blocks of the page's articles (else of ``main``, else of the whole page) without templates and marked
    furniture, and what decides them: ``templates`` if these alone leave the same text of the whole page, else the
    ``article`` or ``main`` element, else the ``marks`` of the page."""
    gone = _template_parts(root, templates) if templates != Templates() else set()
    kind, tops = _roots(root)
    blocks = _blocks(tops, gone, True)
    alone = bool(gone) and _blocks([root], gone, False) == blocks
    return blocks, "templates" if alone else kind if kind != "page" else "marks"
