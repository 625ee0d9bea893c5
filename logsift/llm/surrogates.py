"""Personal data is replaced by surrogates of the same type and form.

A detected entity has a kind and a canonical form: lower-case letters of an address,
digits of a number, lower-case part of a name. Its surrogate is drawn by HMAC with a
secret key from kind, canonical form and attempt, so one entity gets one surrogate
wherever and however it is written (coreference), and it keeps length, grouping,
case, character classes, check digits, script, and for given names gender.

Two passes over the texts. The first gathers the distinct entities; their surrogates
are checked in Spark against each other and against all originals of the kind, and
whoever collides draws again until none does (distinctness); who draws very often gets a
longer surrogate, so that those of a form cannot run out. Only entities that drew
more than once are carried to the second pass, which detects again and replaces; texts
are not shuffled for that. If those entities are too many to broadcast, they are
joined to the documents instead.

Null and empty texts stay as they are. Texts are read whole. Repeated rows get equal
texts. Extra columns are kept; columns named like an added one are replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.tables import extended, portions, without
from logsift.sources.storage import saved

KEY = "surrogates-1"
#: Up to so many entities with more than one draw are broadcast.
BROADCAST_ENTITIES = 50_000

ADDED = {"clean_text": "string", "n_entities": "long", "kinds": "array<string>"}
_SCHEMA = "kind string, canonical string"


@dataclass(frozen=True)
class Found:
    begin: int
    end: int
    kind: str
    surface: str

    @property
    def canonical(self) -> str:
        if self.kind in ("phone", "card", "ssn"):
            return re.sub(r"\D", "", self.surface)
        if self.kind == "iban":
            return self.surface.replace(" ", "")
        if self.kind == "email" or self.kind.startswith(("given", "family")):
            return self.surface.lower()
        return self.surface


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_rest(iban: str) -> int:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97


def _address(text: str) -> bool:
    try:
        ipaddress.IPv4Address(text)
    except ValueError:
        return False
    return True


def _card(digits: str) -> bool:
    issued = digits[0] in "3456" or 2221 <= int(digits[:4]) <= 2720
    return issued and 13 <= len(digits) <= 19 and luhn(digits)


_EMAIL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SECRET = re.compile(
    r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_/+\-]{8,})"
)
_NUMBERS: list[tuple[str, re.Pattern, Callable[[str], bool]]] = [
    ("key", re.compile(r"\bAKIA[0-9A-Z]{16}\b"), lambda s: True),
    (
        "iban",
        re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
        lambda s: iban_rest(s.replace(" ", "")) == 1,
    ),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"), _address),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), lambda s: True),
    (
        "card",
        re.compile(r"(?<![\d-])(?:[2-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3[47]\d\d[ -]?\d{6}[ -]?\d{5})(?![\d-])"),
        lambda s: _card(re.sub(r"\D", "", s)),
    ),
    (
        "phone",
        re.compile(
            r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
            r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
        ),
        lambda s: 7 <= len(re.sub(r"\D", "", s)) <= 15,
    ),
]
_HONORIFIC = re.compile(
    r"\b(Mrs|Ms|Miss|Mr|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|Господин|Госпожа)\.?"
    r" ([^\W\d_a-zà-ÿа-я][^\W\d_A-Z]+)(?: ([^\W\d_a-zà-ÿа-я][^\W\d_A-Z]+))?"
)
_FEMALE = {"mrs", "ms", "miss", "frau", "madame", "mme", "señora", "sra", "госпожа"}


def _script(word: str) -> str:
    return "cyrillic" if re.match(r"[Ѐ-ӿ]", word) else "latin"


def detect(text: str | None) -> list[Found]:
    """Entities of a text, in order, none inside another."""
    found: list[Found] = []
    if not text:
        return found
    if "@" in text:
        found += (Found(m.start(), m.end(), "email", m[0]) for m in _EMAIL.finditer(text))
    if re.search(r"[=:]\s*[\"']?[A-Za-z0-9_/+\-]{8}", text):
        found += (Found(m.start(1), m.end(1), "secret", m[1]) for m in _SECRET.finditer(text))
    if re.search(r"\d[\d .()-]{5}|AKIA|[A-Z]{2}\d\d", text):
        for kind, pattern, sound in _NUMBERS:
            found += (Found(m.start(), m.end(), kind, m[0]) for m in pattern.finditer(text) if sound(m[0]))
    for m in _HONORIFIC.finditer(text):
        gender = "female" if m[1].lower() in _FEMALE else "male"
        if m[3]:
            found.append(Found(m.start(2), m.end(2), f"given {gender} {_script(m[2])}", m[2]))
            found.append(Found(m.start(3), m.end(3), f"family {gender} {_script(m[3])}", m[3]))
        else:
            found.append(Found(m.start(2), m.end(2), f"family {gender} {_script(m[2])}", m[2]))
    found.sort(key=lambda f: (f.begin, -f.end))
    kept: list[Found] = []
    for f in found:
        if not kept or f.begin >= kept[-1].end:
            kept.append(f)
    return kept


class _Draws:
    """Numbers that key, kind, canonical form and attempt decide."""

    def __init__(self, key: str, kind: str, canonical: str, attempt: int) -> None:
        self.seed = f"{kind}\0{canonical}\0{attempt}".encode("utf-8", "surrogatepass")
        self.key, self.block, self.held = key.encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.held) < 4:
            self.held += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.held = int.from_bytes(self.held[:4], "big"), self.held[4:]
        return value % n

    def like(self, text: str) -> str:
        """The same classes of characters, other characters."""
        out = []
        for c in text:
            if c.isdigit():
                out.append("0123456789"[self.below(10)])
            elif c.isalpha():
                drawn = "abcdefghijklmnopqrstuvwxyz"[self.below(26)]
                out.append(drawn.upper() if c.isupper() else drawn)
            else:
                out.append(c)
        return "".join(out)


_SYLLABLES = {
    "latin": ["ba", "ve", "lo", "mi", "ra", "ne", "to", "sil", "dar", "ken", "ul", "por", "han", "ri", "gel", "ma"],
    "cyrillic": ["ба", "ве", "ло", "ми", "ра", "не", "то", "сил", "дар", "кен", "ул", "пор", "ган", "ри", "гел", "ма"],
}
_LAST = {
    ("given", "female", "latin"): ["na", "lia", "ra", "sa"],
    ("given", "male", "latin"): ["rik", "mon", "los", "ter"],
    ("family", "female", "latin"): ["berg", "son", "feld", "mont"],
    ("given", "female", "cyrillic"): ["на", "лия", "ра", "са"],
    ("given", "male", "cyrillic"): ["рик", "мон", "лос", "тер"],
    ("family", "female", "cyrillic"): ["ова", "ева", "ина", "ская"],
    ("family", "male", "cyrillic"): ["ов", "ев", "ин", "ский"],
}
_LAST["family", "male", "latin"] = _LAST["family", "female", "latin"]


def surrogate(key: str, kind: str, canonical: str, attempt: int) -> str:
    """The canonical form of an entity's surrogate."""
    draw = _Draws(key, kind, canonical, attempt)
    # Who draws very often gets a longer one, so that the surrogates of a form cannot run out.
    more = "0" * (attempt // 16)
    if kind == "email":
        name, _, domain = canonical.rpartition("@")
        # One domain has one surrogate; short names get letters added if they draw often.
        host = _Draws(key, "domain", domain, 0).like(domain.rpartition(".")[0])
        return f"{draw.like(name)}{draw.like('a' * (attempt // 4))}@{host}.example"
    if kind == "ip":
        if attempt < 8:
            return ".".join(["10", *(str(draw.below(256)) for _ in range(3))])
        return ".".join([str(1 + draw.below(223)), *(str(draw.below(256)) for _ in range(3 + len(more)))])
    if kind == "key":
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
        return canonical[:4] + "".join(alphabet[draw.below(32)] for _ in canonical[4:])
    if kind == "secret":
        hexadecimal = re.fullmatch(r"[0-9a-f]+", canonical)
        return "".join("0123456789abcdef"[draw.below(16)] for _ in canonical + more) if hexadecimal else draw.like(canonical + more)
    if kind == "iban":
        rest = draw.like(canonical[4:])
        return f"{canonical[:2]}{98 - iban_rest(f'{canonical[:2]}00{rest}'):02d}{rest}"
    if kind == "card":
        body = canonical[0] + draw.like(canonical[1:] + more)
        if luhn(canonical):
            body = next(body[:-1] + c for c in "0123456789" if luhn(body[:-1] + c))
        return body
    if kind == "phone":
        # Country and first digits stay in range; 1 to 9 at the front.
        head = canonical[: max(0, len(canonical) - 10)]
        return head + str(2 + draw.below(8)) + draw.like(canonical[len(head) + 1 :] + more)
    if kind == "ssn":
        return "9" + draw.like(canonical[1:] + more)
    part, gender, script = kind.split()
    syllables, last = _SYLLABLES[script], _LAST[part, gender, script]
    middle = [syllables[draw.below(16)] for _ in range(2 + attempt // 2)]
    return "".join(middle) + last[draw.below(len(last))]


def written(kind: str, surface: str, drawn: str) -> str:
    """A surrogate in the form of the surface."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(drawn)
        return re.sub(r"\d", lambda _: next(digits), surface) + "".join(digits)
    if kind == "iban":
        signs = iter(drawn)
        return "".join(c if c == " " else next(signs) for c in surface)
    if kind == "email":
        if surface.isupper():
            return drawn.upper()
        return "".join(d.upper() if s.isupper() else d for d, s in zip(drawn, surface.ljust(len(drawn)), strict=False))
    if kind.startswith(("given", "family")):
        return drawn.upper() if surface.isupper() and len(surface) > 1 else drawn.capitalize()
    return drawn


def replaced(text: str | None, attempts: dict[tuple[str, str], int], key: str) -> tuple[str | None, list[str]]:
    """The text with surrogates, and the kinds replaced, in order."""
    found = detect(text)
    if not found:
        return text, []
    out, at = [], 0
    for f in found:
        drawn = surrogate(key, f.kind, f.canonical, attempts.get((f.kind, f.canonical), 0))
        out += [text[at : f.begin], written(f.kind, f.surface, drawn)]
        at = f.end
    return "".join([*out, text[at:]]), [f.kind for f in found]


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        pairs = sorted({(f.kind, f.canonical) for t in batch.column("text").to_pylist() for f in detect(t)})
        columns = [pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "canonical"])


def _drawer(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("kind", "canonical", "attempt")), strict=True)
            drawn = pa.array([surrogate(key, *row) for row in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, drawn], names=[*batch.schema.names, "drawn"])

    return run


def redrawn(docs: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canonical, attempt of the entities that had to draw more than once.

    After this no two entities of a kind have the same surrogate, and no surrogate is
    an original of its kind.
    """
    originals = saved(docs.select("text").mapInArrow(_entities, _SCHEMA).distinct())
    drawn = originals.withColumn("attempt", F.lit(0)).mapInArrow(_drawer(key), f"{_SCHEMA}, attempt int, drawn string")
    state = saved(drawn)
    taken = originals.select("kind", F.col("canonical").alias("drawn"), F.lit(True).alias("taken"))
    while True:
        # Those settled earlier come first, so they never move again.
        order = Window.partitionBy("kind", "drawn").orderBy("attempt", "canonical")
        judged = state.withColumn("place", F.row_number().over(order)).join(taken, ["kind", "drawn"], "left")
        judged = saved(judged.withColumn("collides", (F.col("place") > 1) | F.col("taken").isNotNull()))
        again = judged.filter("collides").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        if again.isEmpty():
            return state.filter("attempt > 0").select("kind", "canonical", "attempt")
        settled = judged.filter("not collides").select("kind", "canonical", "attempt", "drawn")
        state = saved(settled.unionByName(again.mapInArrow(_drawer(key), settled.schema)))


def _with_overrides(docs: DataFrame, extra: DataFrame) -> DataFrame:
    """Adds the redrawn entities of each text, for when they are too many to broadcast."""
    key, mark = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows = [
                {"key": k, "mark": m, "kind": f.kind, "canonical": f.canonical}
                for k, m, t in zip(*(batch.column(n).to_pylist() for n in ("key", "mark", "text")), strict=True)
                for f in detect(t)
            ]
            schema = pa.schema([("key", pa.string()), ("mark", pa.int64()), ("kind", pa.string()), ("canonical", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = docs.select(key.alias("key"), mark.alias("mark"), "text")
    met = rows.mapInArrow(spread, f"key string, mark long, {_SCHEMA}").distinct().join(extra, ["kind", "canonical"])
    lists = met.groupBy("key", "mark").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("overrides"))
    lists = lists.select(F.col("key").alias("k"), F.col("mark").alias("m"), "overrides")
    return docs.join(lists, (key == F.col("k")) & (mark == F.col("m")), "left").drop("k", "m")


def replace(docs: DataFrame, key: str = KEY, broadcast_entities: int = BROADCAST_ENTITIES) -> DataFrame:
    """The documents' columns with clean_text, n_entities and kinds."""
    extra = redrawn(docs, key)
    rows = docs.select(*without(docs, *ADDED, "overrides"))
    schema = extended(rows, ADDED)
    small = extra.limit(broadcast_entities + 1).count() <= broadcast_entities
    held = None
    if small:
        pairs = {(r["kind"], r["canonical"]): r["attempt"] for r in extra.collect()}
        held = docs.sparkSession.sparkContext.broadcast(pairs)
    else:
        rows = _with_overrides(rows, extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = batch.column("text").to_pylist()
            if held is not None:
                own = [held.value] * len(texts)
            else:
                lists = batch.column("overrides").to_pylist()
                own = [{(o["kind"], o["canonical"]): o["attempt"] for o in x or ()} for x in lists]
                batch = batch.drop_columns(["overrides"])
            done = [replaced(t, a, key) for t, a in zip(texts, own, strict=True)]
            made = [
                pa.array([t for t, _ in done], pa.string()),
                pa.array([len(k) for _, k in done], pa.int64()),
                pa.array([sorted(set(k)) for _, k in done], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *ADDED])

    return rows.mapInArrow(run, schema)
