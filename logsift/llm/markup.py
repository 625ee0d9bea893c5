"""HTML as a tree: tokens, implied ends, and what tags and their attributes say."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element names by their meaning in HTML, and words that site authors use in class and id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text that no reader sees as part of a page.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr output"
    " picture q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre"
    " search section select summary table tbody td template tfoot th thead tr ul noscript svg math object video audio"
    " canvas button".split()
)
NOISE_TAGS = frozenset(
    "head nav footer aside script style title textarea xmp iframe noembed noframes noscript template svg math object"
    " video audio canvas button select option optgroup input dialog menu datalist search".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager skip toolbar topbar masthead footer"
    " sidebar sidebars rightbar leftbar rail aside widget widgets ad ads adv advert adverts advertisement advertisements"
    " advertising adsense adbox adslot adunit leaderboard sponsor sponsored sponsors promo promos promotion promoted"
    " banner outbrain taboola cookie cookies consent gdpr notice notices notification notifications alert alerts popup"
    " modal overlay dialog lightbox toast newsletter subscribe subscription signup signin login register search share"
    " sharing sharebar social related recommended recommendations trending comment comments commentlist disqus respond"
    " reply replies copyright hidden".split()
)
#: Roles of the accessibility standard for what is not the main content.
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form status menu menubar".split())
CONTENT_WORDS = frozenset("content article post entry story main body text articlebody".split())
#: Words that make a header part of an article.
ARTICLE_WORDS = frozenset("article post entry story".split())
#: Only these make an article element something else.
NOT_ARTICLE = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related".split())
#: A class that begins so speaks of the page around, not of the element.
ABOUT_PAGE = ("no-", "has-", "with-", "without-", "is-", "not-")
COMMENT_HEADING = re.compile(
    r"(?:\d+ )?(?:reader |user )?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)(?: \(\d+\))?:?", re.I
)
#: An element of the left closes open elements of the right up to a boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
_HEAD_TAGS = frozenset("meta title link script style base noscript template".split())
_SCOPE = frozenset("table td th caption object template".split())

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|</?[a-zA-Z](?:[^>"'=]++|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+(?:>|\Z)""",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(
    r"""[\s"'/](class|id|role|itemprop|style|hidden|aria-hidden)(?=[\s=/>])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I
)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(frozen=True, slots=True)
class Tag:
    """What a start tag says: its name, how it is known in a wrapper, and what it stands for."""

    name: str
    #: The name with the words of class and id (digits left out); the name with its role.
    key: str
    coarse: str
    #: "noise", "header", "form", "article", "main", "content" or "".
    role: str


def _words(values: list[str]) -> tuple[set[str], list[str]]:
    words, tokens = set(), []
    for value in values:
        for token in value.split():
            plain = "".join(c for c in token if not c.isdigit()).strip("-_")[:40]
            if plain:
                tokens.append(plain)
            if token.lower().startswith(ABOUT_PAGE):
                continue
            for piece in re.split(r"[^A-Za-z]+", token):
                words.add(piece.lower())
                words.update(p.lower() for p in _PART.findall(piece))
    return words, tokens


def _role(name: str, words: set[str], roles: set[str], props: str) -> str:
    if name in NOISE_TAGS:
        return "noise"
    if name in ("html", "body"):
        return ""
    if name == "article" or "articlebody" in props:
        return "noise" if words & NOT_ARTICLE else "article"
    if name == "main" or "main" in roles:
        return "main"
    if words & NOISE_WORDS or roles & NOISE_ROLES:
        return "noise"
    if name == "header" or ("header" in words and not words & ARTICLE_WORDS):
        return "header"
    if name == "form":
        return "form"
    return "content" if words & CONTENT_WORDS and name not in INLINE else ""


def tag_of(raw: str) -> Tag:
    """The tag of a start token."""
    name = _NAME.match(raw)[1].lower()
    if name not in BLOCK and name not in INLINE and name not in VOID and name not in RAW:
        known = "other"
    else:
        known = name
    found: dict[str, str] = {}
    if len(raw) > len(name) + 2:
        for match in _ATTRIBUTE.finditer(raw):
            found.setdefault(match[1].lower(), match[2] or match[3] or match[4] or "")
    if not found:
        role = _role(name, set(), set(), "")
        return Tag(name, known, f"{known}:{role}" if role else known, role)
    words, tokens = _words([found.get("class", ""), found.get("id", "")])
    role = _role(name, words, set(found.get("role", "").lower().split()), found.get("itemprop", "").lower())
    unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _INVISIBLE.search(found.get("style", ""))
    if unseen and name not in ("html", "body"):
        role = "noise"
    return Tag(name, ".".join([known, *sorted(set(tokens))]), f"{known}:{role}" if role else known, role)


class Node:
    """An element with its texts and elements in order."""

    __slots__ = ("kids", "tag")

    def __init__(self, tag: Tag) -> None:
        self.tag, self.kids = tag, []


_ROOT = Tag("html", "html", "html", "")
_TAGS: dict[str, Tag] = {}


def _known(raw: str) -> Tag:
    tag = _TAGS.get(raw)
    if tag is None:
        tag = tag_of(raw)
        if len(raw) <= 200:
            if len(_TAGS) >= 1 << 14:
                _TAGS.clear()
            _TAGS[raw] = tag
    return tag


def _close_implied(open_: list[Node], name: str) -> None:
    if name in IMPLIED:
        closes, stops = IMPLIED[name]
        at = len(open_) - 1
        last = 0
        while at > 0 and open_[at].tag.name not in stops:
            if open_[at].tag.name in closes:
                last = at
            elif open_[at].tag.name in ("article", "section", "main", "body"):
                break
            at -= 1
        if last:
            del open_[last:]
    if name in BLOCK:
        at = len(open_) - 1
        while at > 0 and open_[at].tag.name != "p" and open_[at].tag.name not in BLOCK:
            at -= 1
        if at > 0 and open_[at].tag.name == "p":
            del open_[at:]


def _close(open_: list[Node], name: str) -> bool:
    for at in range(len(open_) - 1, 0, -1):
        other = open_[at].tag.name
        if other == name:
            del open_[at:]
            return True
        if (name not in BLOCK and other in BLOCK) or (other in _SCOPE and name not in ("table", "tr", "tbody", "thead", "tfoot", "body")):
            return False
    return False


def parse(page: str) -> Node:
    """The tree of a page: unclosed elements end where HTML ends them, stray ends are passed over.

    Texts are decoded. Comments, declarations and the content of scripts and the like
    are not in the tree.
    """
    root = Node(_ROOT)
    open_ = [root]
    at = 0

    def text(upto: int) -> None:
        if upto > at:
            piece = page[at:upto]
            open_[-1].kids.append(html.unescape(piece) if "&" in piece else piece)

    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            text(len(page))
            return root
        text(token.start())
        at = token.end()
        raw = token[0]
        if raw[1] in "!?":
            continue
        if raw[-1] != ">":
            # A tag cut off by the end of the page.
            return root
        if raw[1] == "/":
            name = _NAME.match(raw)[1].lower()
            if name == "br":
                open_[-1].kids.append(" ")
            elif name not in ("html", "body") and not _close(open_, name) and name == "p":
                open_[-1].kids.append(Node(_known("<p>")))
            continue
        tag = _known(raw)
        name = tag.name
        if name in ("html", "body"):
            while len(open_) > 1 and open_[-1].tag.name == "head":
                open_.pop()
            if name == "html" or any(n.tag.name == "body" for n in open_):
                continue
        if name not in _HEAD_TAGS and open_[-1].tag.name == "head":
            open_.pop()
        _close_implied(open_, name)
        node = Node(tag)
        open_[-1].kids.append(" " if name == "br" else node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID:
            open_.append(node)
