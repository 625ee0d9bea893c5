"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

1. Every page is a stream of tokens (start, text, end). Its repeats are aligned with
   each other, then pages of one host are aligned with what the earlier ones gave,
   one after another: a text that differs becomes a text slot; an element that one
   side lacks becomes optional; a row of the same elements becomes a repeated
   element; elements that come back after others become a repeated group of
   optional elements. The expression is union-free: an element, slot or group, with
   `?`, `+` or `*`, and a sequence of these. In an element's content every kind
   of element stands once, so an expression cannot outgrow the kinds of paths.
2. Aligning is associative in all that step 3 reads, so every task aligns its own
   pages, parts of a host are aligned with each other (`PARTS` groups a host), then
   the parts; a host with a third of all pages needs no task of its own. All pages
   take part.
3. A host's wrapper is labelled once: which elements hold the article, which slots
   are the same on all pages or are links only (see `rule_of`). Every page is then
   matched with its host's wrapper where it is read, and the texts of main slots
   come out as blocks.

Labels of hosts are broadcast while all of them take at most `BROADCAST_BYTES`.
Beyond that only those of hosts with over a thousandth of all pages are (1,000 at
most); other pages meet theirs in a shuffle by host.

Main text is the article (`article` elements, else `main`, else the container
that holds most of the text that varies) without menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, hidden elements and readers' comments.
A header inside an article belongs to it. Character references are decoded; white
space (`br` included) becomes one space, ends are trimmed; blocks are the runs of text
between starts and ends of block elements, joined by a newline in page order.

Null, empty and unreadable html gives an empty text. A page whose url is null or has
no host belongs to the host ''. Repeated rows give repeated rows; ids may be null
or repeated. Very long and very deep pages are read whole: below `DEPTH` levels a
page is not described by its wrapper, only by its own tags. An empty table gives an
empty result. Extra columns are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.markup import BLOCK, COMMENT_HEADING, HEADINGS, Node, parse
from logsift.llm.tables import portions
from logsift.sources.storage import saved

#: Elements below this many levels are not told apart by a wrapper.
DEPTH = 40
#: A wrapper with more elements forgets classes, then all below `SHALLOW` levels.
NODES = 4000
SHALLOW = 6
#: Hosts whose wrappers a task holds before it hands them on.
HOSTS = 500
PARTS = 64
BROADCAST_BYTES = 32 << 20
#: A text is the template's if it is the same on all of at least so many pages.
SAME_ON = 3
#: Share of the varying text that a container must hold to be gone into.
MOST = 0.8
#: Share of links in a text that makes it a menu.
LINKS = 0.8
#: Texts that a task reads at a time.
ROWS = 200
_VARIES = -1
_PROSE = frozenset("p li td th dd dt blockquote pre h1 h2 h3 h4 h5 h6 figcaption caption summary legend ul ol dl table tbody tr".split())


class Wrapper:
    """One element of a union-free expression, over all pages aligned so far.

    model: the content as segments (keys, repeated); a segment of several keys is a
    repeated group of optional elements. "#" is the text slot.
    """

    __slots__ = ("chars", "kids", "links", "model", "pages", "same", "tag", "role")

    def __init__(self, tag: str, role: str) -> None:
        self.tag, self.role = tag, role
        self.kids: dict[str, Wrapper] = {}
        self.model: list[tuple[list[str], bool]] = []
        self.pages, self.chars, self.links = 0, 0, 0
        #: None without a text, the hash of the one text met, or _VARIES.
        self.same: int | None = None


def _push(model: list[tuple[list[str], bool]], key: str, repeated: bool = False) -> None:
    """One more item; an item met before makes a group of all since."""
    for place, (keys, _) in enumerate(model):
        if key in keys:
            inside = [k for ks, _ in model[place:] for k in ks]
            model[place:] = [(inside, True)]
            return
    model.append(([key], repeated))


def _cover(model: list[tuple[list[str], bool]], keys: list[str], repeated: bool) -> None:
    """One segment for all these keys."""
    places = [p for p, (ks, _) in enumerate(model) if not set(ks).isdisjoint(keys)]
    first, last = places[0], places[-1]
    if first < last:
        model[first : last + 1] = [([k for ks, _ in model[first : last + 1] for k in ks], True)]
    elif repeated and not model[first][1]:
        model[first] = (model[first][0], True)


def _rising(places: list[int]) -> list[int]:
    """Indexes of a longest rising run of places, left to right."""
    tails: list[int] = []
    before = [-1] * len(places)
    for i, place in enumerate(places):
        low, high = 0, len(tails)
        while low < high:
            middle = (low + high) // 2
            if places[tails[middle]] < place:
                low = middle + 1
            else:
                high = middle
        before[i] = tails[low - 1] if low else -1
        tails[low : low + 1] = [i]
    out, at = [], tails[-1] if tails else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def _aligned(a: list[tuple[list[str], bool]], b: list[tuple[list[str], bool]]) -> list[tuple[list[str], bool]]:
    """Both contents as one: common items in common order meet, others are taken in between."""
    if a == b:
        return a
    left, right = [k for ks, _ in a for k in ks], [k for ks, _ in b for k in ks]
    place = {k: i for i, k in enumerate(left)}
    common = [k for k in right if k in place]
    anchors = [common[i] for i in _rising([place[k] for k in common])]
    model: list[tuple[list[str], bool]] = []
    i = j = 0
    for anchor in [*anchors, None]:
        while i < len(left) and left[i] != anchor:
            _push(model, left[i])
            i += 1
        while j < len(right) and right[j] != anchor:
            _push(model, right[j])
            j += 1
        if anchor is not None:
            _push(model, anchor)
            i, j = i + 1, j + 1
    for keys, repeated in [*a, *b]:
        _cover(model, keys, repeated)
    return model


def align(a: Wrapper, b: Wrapper, one_page: bool = False) -> Wrapper:
    """Takes b's pages into a. Instances on one page count as one page."""
    a.pages = max(a.pages, b.pages) if one_page else a.pages + b.pages
    a.chars += b.chars
    a.links += b.links
    if a.same is None or b.same is None:
        a.same = b.same if a.same is None else a.same
    elif a.same != b.same:
        a.same = _VARIES
    a.model = _aligned(a.model, b.model)
    for key, kid in b.kids.items():
        if key in a.kids:
            align(a.kids[key], kid, one_page)
        else:
            a.kids[key] = kid
    return a


def _size(wrapper: Wrapper) -> int:
    return 1 + sum(map(_size, wrapper.kids.values()))


def _key(node: Node, detail: int) -> str:
    return node.tag.key if detail == 2 else node.tag.coarse


def _levels(detail: int) -> int:
    return DEPTH if detail else SHALLOW


def _plain(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _visible(node: Node) -> str:
    """All text below an element, at any depth."""
    parts, waiting = [], [node]
    while waiting:
        one = waiting.pop()
        if isinstance(one, str):
            parts.append(one)
        else:
            parts.append(" ")
            waiting.extend(reversed(one.kids))
    return _plain(parts)


def wrapper_of(page: Node, detail: int) -> Wrapper:
    """A page's own expression: its elements aligned with their repeats."""

    def build(node: Node, level: int, linked: bool) -> Wrapper:
        made = Wrapper(node.tag.name, node.tag.role)
        made.pages = 1
        texts: list[str] = []
        last = None
        if level >= _levels(detail):
            texts, elements = [_visible(node)], []
        else:
            elements = node.kids
        for kid in elements:
            if isinstance(kid, str):
                texts.append(kid)
                key = "#" if kid.strip() else None
            else:
                texts.append(" ")
                key = _key(kid, detail)
                below = build(kid, level + 1, linked or kid.tag.name == "a")
                known = made.kids.get(key)
                made.kids[key] = below if known is None else align(known, below, one_page=True)
            if key is None:
                continue
            if key == last:
                made.model[-1] = (made.model[-1][0], True)
            else:
                _push(made.model, key)
            last = key if made.model[-1][0] == [key] else None
        own = _plain(texts)
        if own:
            made.same = xxhash.xxh3_64_intdigest(own.encode("utf-8", "surrogatepass")) >> 1
            made.chars = len(own)
            made.links = len(own) if linked else 0
        return made

    return build(page, 0, False)


def reduced(wrapper: Wrapper, detail: int) -> Wrapper:
    """The expression as pages read in less detail would have given it."""

    def reduce(old: Wrapper, level: int) -> Wrapper:
        new = Wrapper(old.tag, old.role)
        new.pages, new.chars, new.links, new.same = old.pages, old.chars, old.links, old.same
        names = {"#": "#"}
        kids: dict[str, Wrapper] = {}
        for key, kid in old.kids.items():
            less = reduce(kid, level + 1)
            if level >= _levels(detail):
                new.chars, new.links, new.same = new.chars + less.chars, new.links + less.links, _VARIES
                continue
            names[key] = coarse = key.split(":")[0].split(".")[0] + (f":{kid.role}" if kid.role else "")
            if coarse in kids:
                # Which instances share a page is no longer known; no less than the larger count do.
                align(kids[coarse], less, one_page=True)
            else:
                kids[coarse] = less
        new.kids = kids
        for keys, repeated in old.model if level < _levels(detail) else []:
            coarse_keys = list(dict.fromkeys(names[k] for k in keys))
            for k in coarse_keys:
                _push(new.model, k)
            _cover(new.model, coarse_keys, repeated)
        return new

    return reduce(wrapper, 0)


# --- as text -------------------------------------------------------------------


def packed(wrapper: Wrapper) -> str:
    def fields(w: Wrapper) -> list:
        model = [[keys, int(repeated)] for keys, repeated in w.model]
        return [w.tag, w.role, w.pages, w.chars, w.links, w.same, model, {k: fields(v) for k, v in w.kids.items()}]

    return json.dumps(fields(wrapper), separators=(",", ":"))


def unpacked(text: str) -> Wrapper:
    def made(fields: list) -> Wrapper:
        w = Wrapper(fields[0], fields[1])
        w.pages, w.chars, w.links, w.same = fields[2:6]
        w.model = [(keys, bool(repeated)) for keys, repeated in fields[6]]
        w.kids = {k: made(v) for k, v in fields[7].items()}
        return w

    return made(json.loads(text))


def expression(wrapper: Wrapper) -> str:
    """The wrapper written out: `#` a text slot, `=` a text that is the same on all pages."""

    def item(w: Wrapper, key: str, pages: int) -> str:
        if key == "#":
            return "#" if w.same == _VARIES else "="
        kid = w.kids[key]
        body = content(kid)
        return f"<{key}>{body}</>" + ("" if kid.pages >= pages else "?")

    def content(w: Wrapper) -> str:
        out = []
        for keys, repeated in w.model:
            text = " ".join(item(w, k, w.pages) for k in keys)
            if repeated and len(keys) > 1:
                text = "(" + " ".join(t if t.endswith("?") else t + "?" for t in (item(w, k, w.pages) for k in keys)) + ")+"
            elif repeated:
                text = text[:-1] + "*" if text.endswith("?") else text + "+"
            out.append(text)
        return " ".join(out)

    return content(wrapper)


# --- labels --------------------------------------------------------------------


def _walk(wrapper: Wrapper, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Wrapper]]:
    yield path, wrapper
    for key, kid in wrapper.kids.items():
        yield from _walk(kid, (*path, key))


def _weights(wrapper: Wrapper, pages: int) -> tuple[dict[int, int], dict[int, int]]:
    """Per element: characters below it that vary, are no links and no noise; articles below it."""
    varying: dict[int, int] = {}
    articles: dict[int, int] = {}

    def weigh(w: Wrapper, in_article: bool) -> tuple[int, int]:
        if w.role == "noise" or (w.role == "header" and not in_article):
            varying[id(w)], articles[id(w)] = 0, 0
            for kid in w.kids.values():
                weigh(kid, in_article)
            return 0, sum(articles[id(k)] for k in w.kids.values()) + (w.role == "article")
        own = 0 if _is_template(w, [w], pages) else w.chars - w.links
        held = int(w.role in ("article", "main"))
        for kid in w.kids.values():
            more, found = weigh(kid, in_article or w.role == "article")
            own, held = own + more, held + found
        varying[id(w)], articles[id(w)] = own, held
        return own, held

    weigh(wrapper, False)
    return varying, articles


def _line(w: Wrapper, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Wrapper]]:
    """An element and the inline elements whose texts stand in its blocks."""
    yield path, w
    for key, kid in w.kids.items():
        if kid.tag not in BLOCK and kid.role != "noise":
            yield from _line(kid, (*path, key))


def _is_template(w: Wrapper, line: list[Wrapper], pages: int) -> bool:
    """A block of the template: all its texts one and the same, on most pages of the host."""
    texts = [x.same for x in line if x.same is not None]
    return bool(texts) and _VARIES not in texts and w.pages >= SAME_ON and 2 * w.pages >= pages


def rule_of(wrapper: Wrapper, detail: int) -> str:
    """The labels of a wrapper that pages of the host need, as JSON.

    levels: which of "article", "main" hold main text on this host. Articles that are
    repeated on a page and hold less than a third of what `main` or the page does are
    teasers and do not count. containers: paths of the elements to read on pages
    without these. drop: paths of elements in them whose own text is the template's
    or a menu's.
    """
    pages = wrapper.pages
    varying, held = _weights(wrapper, pages)
    total = varying[id(wrapper)]

    def outermost(w: Wrapper, role: str) -> int:
        if w.role == "noise":
            return 0
        return varying[id(w)] if w.role == role else sum(outermost(k, role) for k in w.kids.values())

    levels = [role for role in ("article", "main") if any(w.role == role for _, w in _walk(wrapper))]
    repeated = any(
        rep and any(k in w.kids and w.kids[k].role == "article" for k in keys) for _, w in _walk(wrapper) for keys, rep in w.model
    )
    if "article" in levels and repeated and 3 * outermost(wrapper, "article") < total:
        levels.remove("article")
    containers, drop = [], []
    best = _container(wrapper, varying, total)
    for path, w in best:
        containers.append(path)
        for more, inner in _walk(w):
            if inner.tag in HEADINGS or inner.tag not in BLOCK or not total:
                continue
            line = list(_line(inner))
            chars = sum(x.chars for _, x in line)
            menu = chars and sum(x.links for _, x in line) >= LINKS * chars and _in_list(more)
            if menu or _is_template(inner, [x for _, x in line], pages):
                drop += [(*path, *more, *inside) for inside, _ in line]
    return json.dumps({"detail": detail, "levels": levels, "containers": containers, "drop": drop}, separators=(",", ":"))


def _in_list(path: tuple[str, ...]) -> bool:
    return any(k.split(".")[0].split(":")[0] in ("ul", "ol", "li", "dl", "table") for k in path)


def _container(wrapper: Wrapper, varying: dict[int, int], total: int) -> list[tuple[tuple[str, ...], Wrapper]]:
    """The element that holds most of the varying text, and main headings outside of it."""
    named = [
        (path, w) for path, w in _walk(wrapper) if w.role == "content" and total and varying[id(w)] >= 0.6 * total
    ]
    if named:
        path, at = max(named, key=lambda pair: (len(pair[0]), pair[0]))
    else:
        path, at = (), wrapper
        while True:
            inner = max(at.kids.items(), key=lambda pair: (varying[id(pair[1])], pair[0]), default=None)
            if inner is None or inner[1].tag in _PROSE or not total or varying[id(inner[1])] < MOST * varying[id(at)]:
                break
            if inner[1].tag not in BLOCK:
                break
            path, at = (*path, inner[0]), inner[1]
    found = [(path, at)]
    for other, w in _walk(wrapper):
        if w.tag == "h1" and other[: len(path)] != path and varying[id(w)] and not _below_noise(wrapper, other):
            found.append((other, w))
    return found


def _below_noise(wrapper: Wrapper, path: tuple[str, ...]) -> bool:
    for key in path:
        wrapper = wrapper.kids[key]
        if wrapper.role in ("noise", "header"):
            return True
    return False


# --- one page ------------------------------------------------------------------


class Rule:
    """A host's labels, ready for matching."""

    def __init__(self, text: str) -> None:
        known = json.loads(text)
        self.detail, self.levels = known["detail"], known["levels"]
        #: Labelled paths as nested dicts; the label of a path is under "".
        self.paths: dict = {}
        for name in ("containers", "drop"):
            for path in known[name]:
                at = self.paths
                for key in path:
                    at = at.setdefault(key, {})
                at.setdefault("", set()).add(name)


def _comment_part(node: Node) -> bool:
    """Whether an element other than an article begins with a heading that announces comments."""
    if node.tag.role in ("article", "main") or node.tag.name in ("html", "body"):
        return False
    for kid in node.kids:
        if isinstance(kid, str):
            if kid.strip():
                return False
        else:
            return kid.tag.name in HEADINGS and bool(COMMENT_HEADING.fullmatch(_visible(kid)))
    return False


def _has(page: Node, roles: tuple[str, ...], through: bool) -> bool:
    """Whether a page has an element of these roles, outside noise or also inside of it."""
    waiting = [page]
    while waiting:
        node = waiting.pop()
        if node.tag.role in roles:
            return True
        if through or node.tag.role != "noise":
            waiting.extend(k for k in node.kids if not isinstance(k, str))
    return False


def blocks_of(page: Node, rule: Rule) -> list[str]:
    """The blocks of main text of a page that is matched with its host's wrapper."""
    wanted = next((level for level in rule.levels if _has(page, (level,), False)), None)
    around = False
    if wanted is None:
        # Articles inside what looks like noise: then that is not noise.
        wanted = next((level for level in rule.levels if _has(page, (level,), True)), None)
        around = wanted is not None
    forms = _holders(page, "form")
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = _plain(run)
        if text:
            blocks.append(text)
        run.clear()

    # (node, labels below it, inside main text, inside an article, own text dropped, children left)
    def entered(node: Node, labels: dict | None, main: bool, article: bool):
        own = labels.get("", ()) if labels else ()
        if wanted is None:
            main = main or "containers" in own
        else:
            main = main or node.tag.role == wanted
        return node, labels, main, article or node.tag.role == "article", wanted is None and "drop" in own, iter(node.kids)

    stack = [entered(page, rule.paths, False, False)]
    while stack:
        node, labels, main, article, dropped, kids = stack[-1]
        kid = next(kids, None)
        if kid is None:
            stack.pop()
            if node.tag.name in BLOCK or node.tag.name == "hr":
                end()
            continue
        if isinstance(kid, str):
            if main and not dropped:
                run.append(kid)
            continue
        role = kid.tag.role
        noise = role == "noise" or (role == "header" and not article) or _comment_part(kid)
        if noise and around and not main and _has(kid, (wanted,), True):
            noise = False
        if role == "form" and id(kid) not in forms:
            noise = True
        if kid.tag.name in BLOCK or kid.tag.name == "hr":
            end()
        if noise:
            continue
        # Below the levels that the wrapper describes, labels hold for all.
        below = labels.get(_key(kid, rule.detail)) if labels else None
        stack.append(entered(kid, below, main, article))
    end()
    return blocks


def _holders(page: Node, role: str) -> set[int]:
    """Elements of a role that hold an article, a main part or most of the page's text."""
    found, waiting = [], [page]
    while waiting:
        node = waiting.pop()
        if node.tag.role == role:
            found.append(node)
        waiting.extend(k for k in node.kids if not isinstance(k, str))
    if not found:
        return set()
    whole = len(_visible_prose(page))
    return {id(n) for n in found if _has(n, ("article", "main"), False) or 2 * len(_visible_prose(n)) > whole}


def _visible_prose(node: Node) -> str:
    """Text outside noise and outside links, labels and fields."""
    parts, waiting = [], [node]
    while waiting:
        one = waiting.pop()
        if isinstance(one, str):
            parts.append(one)
        elif one.tag.role != "noise" and one.tag.name not in ("a", "label", "legend"):
            waiting.extend(reversed(one.kids))
    return _plain(parts)


def main_text(page: Node, rule: Rule) -> str:
    return "\n".join(blocks_of(page, rule))


# --- the job -------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """The host of a url in lower case, '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


class _Held:
    """A wrapper with the detail it is kept in."""

    def __init__(self) -> None:
        self.detail, self.wrapper = 2, None

    def _fit(self) -> None:
        while self.detail and _size(self.wrapper) > NODES:
            self.detail -= 1
            self.wrapper = reduced(self.wrapper, self.detail)

    def take(self, other: Wrapper, detail: int) -> None:
        if detail < self.detail and self.wrapper is not None:
            self.wrapper = reduced(self.wrapper, detail)
        elif detail > self.detail:
            other = reduced(other, self.detail)
        self.detail = min(self.detail, detail)
        self.wrapper = other if self.wrapper is None else align(self.wrapper, other)
        self._fit()


_PART_SCHEMA = "host string, part int, detail int, wrapper string"


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() % PARTS
    held: dict[str, _Held] = {}

    def out() -> pa.RecordBatch:
        rows = [(host, part, h.detail, packed(h.wrapper)) for host, h in held.items()]
        held.clear()
        columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["host", "part", "detail", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column("host"), batch.column("html"), strict=True):
            one = held.setdefault(host.as_py(), _Held())
            one.take(wrapper_of(parse(page.as_py() or ""), one.detail), one.detail)
            if len(held) >= HOSTS:
                yield out()
    yield out()


def _merge(table: pa.Table) -> _Held:
    held = _Held()
    for detail, text in sorted(zip(table.column("detail").to_pylist(), table.column("wrapper").to_pylist(), strict=True)):
        held.take(unpacked(text), detail)
    return held


def _merge_parts(table: pa.Table) -> pa.Table:
    held = _merge(table)
    row = {"host": [table.column("host")[0].as_py()], "part": [0], "detail": [held.detail], "wrapper": [packed(held.wrapper)]}
    return pa.table(row, pa.schema([("host", pa.string()), ("part", pa.int32()), ("detail", pa.int32()), ("wrapper", pa.string())]))


_RULES = "host string, n_pages long, expression string, rule string"


def _label(table: pa.Table) -> pa.Table:
    held = _merge(table)
    whole = held.wrapper
    row = {
        "host": [table.column("host")[0].as_py()],
        "n_pages": [whole.pages],
        "expression": [expression(whole)],
        "rule": [rule_of(whole, held.detail)],
    }
    kinds = [("host", pa.string()), ("n_pages", pa.int64()), ("expression", pa.string()), ("rule", pa.string())]
    return pa.table(row, pa.schema(kinds))


def infer(pages: DataFrame) -> DataFrame:
    """host, n_pages, expression (the wrapper written out), rule (its labels): a row per host."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "html")
    parts = rows.mapInArrow(_infer, _PART_SCHEMA)
    merged = parts.groupBy("host", "part").applyInArrow(_merge_parts, _PART_SCHEMA)
    return merged.groupBy("host").applyInArrow(_label, _RULES)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules: dict[str, Rule] = {}
    for batch in portions(batches, ROWS):
        texts = []
        for page, text in zip(batch.column("html"), batch.column("rule"), strict=True):
            key = text.as_py()
            rule = rules.get(key)
            if rule is None:
                if len(rules) >= HOSTS:
                    rules.clear()
                rule = rules[key] = Rule(key)
            texts.append(main_text(parse(page.as_py() or ""), rule))
        arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text"])


def _with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    held = rules.agg(F.sum(F.octet_length("rule") + F.octet_length("host")).alias("bytes"), F.sum("n_pages").alias("n")).first()
    known = rules.select("host", "rule")
    if (held["bytes"] or 0) <= BROADCAST_BYTES:
        return pages.join(F.broadcast(known), "host")
    often = rules.filter(F.col("n_pages") * 1000 > held["n"])
    seldom = rules.filter(F.col("n_pages") * 1000 <= held["n"]).select("host", "rule")
    common = pages.join(F.broadcast(often.select("host", "rule")), "host")
    others = pages.join(F.broadcast(often.select("host")), "host", "left_anti").join(seldom, "host")
    return common.unionByName(others)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host")
    )
    joined = _with_rules(rows, saved(infer(pages))).select("page_id", "url", "html", "rule")
    done: DataFrame = joined.mapInArrow(_extract, "page_id long, url string, text string")
    return done.withColumn("n_chars", F.char_length("text").cast("long"))


Extractor = Callable[[str], str]


def extractor(pages: list[str]) -> Extractor:
    """The same for pages of one host at hand: a function from html to main text."""
    held = _Held()
    for page in pages:
        held.take(wrapper_of(parse(page), held.detail), held.detail)
    rule = Rule(rule_of(held.wrapper, held.detail)) if held.wrapper else None
    return lambda page: main_text(parse(page), rule) if rule else ""
