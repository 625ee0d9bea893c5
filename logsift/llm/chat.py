"""Chat formatting: conversations as one byte string with turn marks and a loss mask.

A turn becomes `<|im_start|>role\\n`, its text, `<|im_end|>\\n`. Inside texts and roles
a `<`, any backslashes and a `|` in a row get one backslash more, so no text can
hold a mark; in roles, backslashes and line feeds are escaped besides. Both are
undone by `read_back`.

A batch of turns is put together by column: numpy adds up segment lengths to
offsets, makes scatter indices, and copies headers, contents and ends into one
buffer that becomes an Arrow array without further copies.

Turns are dealt out by range of (conv_id, turn), so one conversation with a third
of all rows is formatted by many tasks. A row of the result is a piece of a
conversation: whole turns, as many as fit `PIECE_BYTES`, or a single longer one.

Turns go by turn, equal turns by role and text; repeated rows are turns of their
own. Null text and role count as empty, a null conv_id is a conversation, a null
turn comes first. Only the role `assistant` is under the mask, and only its text.
Extra columns are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.tables import portions

START = b"<|im_start|>"
END = b"<|im_end|>\n"
LEARNED = "assistant"
PIECE_BYTES = 4 << 20

PIECES = (
    "conv_id long, piece_turn long, piece_no long, whole boolean, turns long, "
    "formatted string, loss_from array<long>, loss_to array<long>"
)
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_roles(roles: pa.Array) -> pa.Array:
    plain = pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n")
    return escape(plain)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _scatter(out: np.ndarray, to: np.ndarray, source: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
    """Copy the i-th run of the source to its place in the output."""
    total = int(length.sum())
    if total:
        ends = np.cumsum(length)
        inside = np.arange(total) - np.repeat(ends - length, length)
        out[np.repeat(to, length) + inside] = source[np.repeat(begin, length) + inside]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The flat bytes of a text array, and where each text begins and how long it is."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return flat, offsets[:-1], np.diff(offsets)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; each turn's first byte (and the end); each content's first byte."""
    role_bytes, role_at, role_len = _bytes_of(escape_roles(roles))
    text_bytes, text_at, text_len = _bytes_of(escape(texts))
    n = len(role_len)
    head = len(START) + role_len + 1
    lengths = head + text_len + len(END)
    at = np.concatenate([[0], np.cumsum(lengths)])
    content = at[:-1] + head
    out = np.empty(int(at[-1]), np.uint8)
    fixed = np.frombuffer(START + b"\n" + END, np.uint8)
    zero = np.zeros(n, np.int64)
    _scatter(out, at[:-1], fixed, zero, zero + len(START))
    _scatter(out, at[:-1] + len(START), role_bytes, role_at, role_len)
    out[content - 1] = ord("\n")
    _scatter(out, content, text_bytes, text_at, text_len)
    _scatter(out, content + text_len, fixed, zero + len(START) + 1, zero + len(END))
    return out, at, content


def _pieces(conv: np.ndarray, known: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where a piece begins: at a new conversation, or where the turns in it fill the piece."""
    begins = np.ones(len(conv), bool)
    begins[1:] = (conv[1:] != conv[:-1]) | (known[1:] != known[:-1])
    filled = 0
    for i in range(len(conv)):
        if begins[i] or filled + sizes[i] > PIECE_BYTES:
            begins[i], filled = True, 0
        filled += int(sizes[i])
    return np.flatnonzero(begins)


def _formatted(batch: pa.RecordBatch) -> pa.Table:
    """The pieces of one sorted batch, all marked as not known to be whole."""
    roles, texts = batch.column("role").fill_null(""), batch.column("text").fill_null("")
    out, at, content = assemble(roles, texts)
    conv, known = batch.column("conv_id").fill_null(0).to_numpy(), batch.column("conv_id").is_valid().to_numpy(False)
    first = _pieces(conv, known, np.diff(at))
    last = np.append(first[1:], len(conv))
    edges = np.append(at[first], at[-1])
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out))
    learned = np.flatnonzero(pc.equal(roles, LEARNED).to_numpy(False))
    piece_of = np.searchsorted(first, learned, "right") - 1
    begin = content[learned] - at[first][piece_of]
    end = at[learned + 1] - len(END) - at[first][piece_of]
    holds = np.searchsorted(piece_of, np.arange(len(first) + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(holds, pa.array(x, pa.int64())) for x in (begin, end)]
    take = pa.array(first)
    return pa.table(
        {
            "conv_id": batch.column("conv_id").take(take),
            "piece_turn": batch.column("turn").take(take),
            "turns": pa.array(last - first, pa.int64()),
            "formatted": formatted.cast(pa.string()),
            "loss_from": lists[0],
            "loss_to": lists[1],
        }
    )


def _format_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order. A conversation is whole if others stand before and after it in one batch."""
    number = 0
    for batch in portions(batches, 10_000):
        made = _formatted(batch)
        ids = made["conv_id"].to_pylist()
        whole = [x != ids[0] and x != ids[-1] for x in ids]
        # A conversation in several pieces is joined up later, like one that crosses batches.
        whole = [w and ids[i - 1] != x and ids[i + 1] != x for i, (x, w) in enumerate(zip(ids, whole, strict=True))]
        made = made.append_column("piece_no", pa.array(range(number, number + len(ids)), pa.int64()))
        made = made.append_column("whole", pa.array(whole, pa.bool_()))
        number += len(ids)
        order = ["conv_id", "piece_turn", "piece_no", "whole", "turns", "formatted", "loss_from", "loss_to"]
        yield from made.select(order).combine_chunks().to_batches()


def format_conversations(turns: DataFrame) -> DataFrame:
    """Pieces: conv_id, piece_turn, piece_no (their order), formatted, loss_from and loss_to in bytes.

    whole: this piece is known to be the whole conversation.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    # Rows of one conversation and turn share a task, and tasks are in order.
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format_task, PIECES)


class _Reader:
    """Reads pieces of one conversation, in order, back to turns."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted: str, begins: list[int], ends: list[int]) -> None:
        self.chars += len(formatted)
        for role, text in read_back(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        raw = formatted.encode()
        for begin, end in zip(begins, ends, strict=True):
            text = unescape(raw[begin:end].decode())
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self, conv_id: int | None) -> dict:
        return {
            "conv_id": conv_id,
            "n_turns": self.turns,
            "turns_sha256": self.all.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.chars,
        }


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted string."""
    at = 0
    start, end = START.decode(), END.decode()
    while at < len(formatted):
        head = formatted.index("\n", at)
        stop = formatted.index(end, head)
        yield unescape_role(formatted[at + len(start) : head]), unescape(formatted[head + 1 : stop])
        at = stop + len(end)


_DIGEST_SCHEMA = pa.schema(
    [(n, pa.string() if "sha" in n else pa.int64()) for n in (c.split()[0] for c in DIGESTS.split(", "))]
)


def _digest_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the digests of whole conversations and drops their text; other pieces pass."""
    names = [n for n in _DIGEST_SCHEMA.names if n != "conv_id"]
    for batch in batches:
        made = {n: [] for n in names}
        text = []
        for row in batch.to_pylist():
            done = {}
            if row["whole"]:
                reader = _Reader()
                reader.read(row["formatted"], row["loss_from"], row["loss_to"])
                done = reader.row(row["conv_id"])
            text.append(None if row["whole"] else row["formatted"])
            for n in names:
                made[n].append(done.get(n))
        arrays = [pa.array(made[n], _DIGEST_SCHEMA.field(n).type) for n in names]
        kept = {n: batch.column(n) for n in ("conv_id", "piece_turn", "piece_no", "whole", "loss_from", "loss_to")}
        kept["formatted"] = pa.array(text, pa.string())
        yield pa.RecordBatch.from_arrays([*kept.values(), *arrays], names=[*kept, *names])


def _digest_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the pieces of one conversation after another; whole ones are done already."""
    reader, open_id = None, None
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if reader and (row["whole"] or row["conv_id"] != open_id):
                rows.append(reader.row(open_id))
                reader = None
            if row["whole"]:
                rows.append({n: row[n] for n in _DIGEST_SCHEMA.names})
                continue
            if not reader:
                reader, open_id = _Reader(), row["conv_id"]
            reader.read(row["formatted"], row["loss_from"], row["loss_to"])
        yield pa.RecordBatch.from_pylist(rows, schema=_DIGEST_SCHEMA)
    if reader:
        yield pa.RecordBatch.from_pylist([reader.row(open_id)], schema=_DIGEST_SCHEMA)


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from pieces.

    SHA-256 runs over a conversation from its first to its last byte, so pieces of
    one conversation end up in one task, which streams them; it holds one piece.
    Whole conversations are read where they were made and travel as digests.
    """
    kept = "conv_id long, piece_turn long, piece_no long, whole boolean, loss_from array<long>, loss_to array<long>, formatted string"
    half = pieces.drop("turns").mapInArrow(_digest_whole, kept + ", " + DIGESTS.split(", ", 1)[1])
    dealt = half.repartition("conv_id").sortWithinPartitions("conv_id", "piece_turn", "piece_no")
    return dealt.mapInArrow(_digest_rest, DIGESTS)
