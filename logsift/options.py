"""Checked settings of the log cleaner."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Limits the results depend on.
MAX_DEPTH = 1000
MAX_MARKER_BYTES = 1024
MAX_LINE_BYTES = 1024 * 1024
MAX_BLOCK_BYTES = 10 * 1024 * 1024
MAX_PENDING_BLOCKS = 1000
MAX_BATCH_LINES = 1_000_000

# Fixed value: the default marker.
DEFAULT_MARKER = "Successfully downloaded debug"

# Phrases that open a block.
START_PHRASES = (
    "Invalid read",
    "Invalid write",
    "Syscall param",
    "Use of uninitialised",
    "Conditional jump",
    "bytes in ",
    "still reachable",
    "possibly lost",
    "definitely lost",
    "Process terminating",
)

# What makes a line canonical, in this order (regex, replacement).
CANONICAL_RULES = (
    (r"0x[0-9a-fA-F]+", "0xADDR"),
    (r":[0-9]+", ":LINE"),
    (r"\[[0-9]*\]", "[]"),
    (r"<[^>]*>", "<T>"),
)

# What is deleted from a line before it is shown, in this order.
SCRUB_RULES = (
    (r"0x[0-9a-fA-F]+", ""),
    ("at : ", ""),
    ("by : ", ""),
    (r"\?{3,}", ""),
)


@dataclass(frozen=True)
class CleanOptions:
    """Settings of :func:`logsift.clean`.

    depth        canonical lines that make up a signature, 0 for all of them
    trim         keep only what follows the last marker line
    scrub        delete addresses and unknown frames from the shown text
    marker       literal text of a marker line
    scope        "log": every log by itself; "all": all logs, in the order of
                 their ids, as one long log
    strict       fail on a line or block beyond the size limits; otherwise such lines
                 are kept, and such blocks come line by line from `plans.clean.oversize`
    chunk_bits   ordered work is cut into runs of 2**chunk_bits line numbers
    exact        keep bytes that are no UTF-8: rules work on bytes, and `clean` gives
                 binary columns (see `functions.text.bytes_as_text`)
    """

    depth: int = 1
    trim: bool = True
    scrub: bool = True
    marker: str = DEFAULT_MARKER
    scope: str = "log"
    strict: bool = False
    start_phrases: tuple[str, ...] = START_PHRASES
    canonical_rules: tuple[tuple[str, str], ...] = CANONICAL_RULES
    scrub_rules: tuple[tuple[str, str], ...] = SCRUB_RULES
    chunk_bits: int = 18
    exact: bool = False

    def __post_init__(self) -> None:
        if isinstance(self.depth, bool) or not isinstance(self.depth, int):
            raise ValueError("depth must be an integer")
        if not 0 <= self.depth <= MAX_DEPTH:
            raise ValueError(f"depth must be between 0 and {MAX_DEPTH}")
        if not 1 <= len(self.marker.encode("utf-8")) <= MAX_MARKER_BYTES:
            raise ValueError(f"marker must have 1 to {MAX_MARKER_BYTES} bytes")
        if "\0" in self.marker:
            raise ValueError("marker must not contain NUL")
        if self.scope not in ("log", "all"):
            raise ValueError("scope must be 'log' or 'all'")
        if not self.start_phrases or not all(self.start_phrases):
            raise ValueError("start_phrases must be non-empty texts")
        if not 4 <= self.chunk_bits <= 30:
            raise ValueError("chunk_bits must be between 4 and 30")

    def over_bytes(self) -> CleanOptions:
        """The same options for texts in which every character stands for a byte."""

        def spelled(text: str) -> str:
            return text.encode("utf-8", "surrogatepass").decode("latin-1")

        return replace(
            self,
            marker=spelled(self.marker),
            start_phrases=tuple(map(spelled, self.start_phrases)),
            canonical_rules=tuple((spelled(a), spelled(b)) for a, b in self.canonical_rules),
            scrub_rules=tuple((spelled(a), spelled(b)) for a, b in self.scrub_rules),
        )
