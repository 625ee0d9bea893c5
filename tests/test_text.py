import random

import plain
import pytest
from pyspark.sql import functions as F

from logsift.functions import text as tx
from logsift.functions import values as vl
from logsift.options import SCRUB_RULES, CleanOptions


def test_trim(column):
    texts = ["  hello  ", "\t\nhello\r\n", "hello", "  ", "", "  h e l l o  ", "a \x85", " a\v\f"]
    assert column(tx.trim_white, texts) == [
        "hello", "hello", "hello", "", "", "h e l l o", "a \x85", " a",
    ]
    texts = ["  hello  ", "\t\nhello\r\n", "hello", "  ", "", "hello world  "]
    assert column(tx.trim_end, texts) == ["  hello", "\t\nhello", "hello", "", "", "hello world"]


CANONICAL = [
    ("   at 0x12345678: std::vector<int>::operator[] (vector.cpp:123)[0]",
     "at 0xADDR: std::vector<T>::operator[] (vector.cpp:LINE)[]"),
    ("Invalid read of size 4 at 0xABCDEF: func<char>(file.c:45)[1] by 0x12345: main",
     "Invalid read of size 4 at 0xADDR: func<T>(file.c:LINE)[] by 0xADDR: main"),
    ("   \t\n\r   ", ""),
    ("This is a regular log line.", "This is a regular log line."),
    ("", ""),
    ("   \t ", ""),
    ("??? some error ???", "??? some error ???"),
    ("   at : main by : func", "at : main by : func"),
    ("at 0x1: std::vector<std::map<int, std::pair<int, double>>>::operator[] (vector:1)",
     "at 0xADDR: std::vector<T>>>::operator[] (vector:LINE)"),
    ("a < b", "a < b"),
    ("0xADDR", "0xADDRR"),
    ("[12] [] [1x] :7:8", "[] [] [1x] :LINE:LINE"),
]


def test_canonical(column):
    assert column(tx.canonical, [t for t, _ in CANONICAL]) == [e for _, e in CANONICAL]


def test_random_texts(column):
    rng = random.Random(7)
    pieces = ["0x", "0x1f", ":", ":12", "[", "]", "[3]", "<", ">", "at : ", "by : ", "??", "???", " ", "\t",
              "==12", "==", "==1==", "==12== ", "a", "é", "5", " bytes in ", "7 bytes in 3 blocks",
              " blocks", "Invalid read", "\v", "\r", "at 0x5: "]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(20000)]
    texts += ["==12==" + t for t in texts[:4000]]
    assert column(tx.canonical, texts) == [plain.canonical(t) for t in texts]
    assert column(tx.scrubbed, texts) == [plain.scrubbed(t) for t in texts]
    assert column(tx.is_tool_line, texts) == [plain.is_tool(t) for t in texts]
    assert column(tx.is_leak_head, texts) == [plain.is_head(t) for t in texts]
    assert column(tx.opens_block, texts) == [any(s in t for s in plain.STARTS) for t in texts]
    assert column(tx.is_blank, texts) == [not t.strip(plain.WHITE) for t in texts]
    tool = [t for t in texts if plain.is_tool(t)]
    assert len(tool) > 3000
    assert column(tx.strip_prefix, tool) == [plain.strip_prefix(t) for t in tool]
    assert column(tx.strip_tool_prefix, tool) == [plain.strip_prefix(t) for t in tool]
    assert column(tx.is_nonblank_tool_line, texts) == [
        plain.is_tool(t) and plain.strip_prefix(t) != "" for t in texts
    ]


def test_gated_rules_change_nothing(spark):
    rng = random.Random(9)
    pieces = ["0x", "0x1f", ":12", "[3]", "<a>", "at : ", "by : ", "???", "??", "  ", "\t", " ", "a", "é", "\v"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 7))) for _ in range(5000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    both = tx.with_canonical(tx.with_rules(rows, "t", "shown", SCRUB_RULES), "t", "sig", where=F.col("i") % 2 == 0)
    for r in both.collect():
        assert r["shown"] == plain.scrubbed(r["t"])
        assert r["sig"] == (plain.canonical(r["t"]) if r["i"] % 2 == 0 else None)


def test_required_texts():
    want = {r"0x[0-9a-fA-F]+": "0x", r"\[[0-9]*\]": "[", r"\?{3,}": "???", "a*b": "", "ab?c": "a", r"\d+x": "", "x{0,2}y": "",
            "(?i)a": "", "a|b": "", "ab+c": "ab", "at : ": "at : ", "": ""}
    assert {p: tx.required_text(p) for p in want} == want


def test_opening_lines(column):
    lines = ["==12== Invalid read", "==1== Invalid read", "Invalid read", "==12==x", "==12== 2== y"]
    assert column(tx.is_opening_line, lines) == [True, False, False, False, False]
    assert column(lambda v: tx.is_opening_line(v, ("2==",)), lines) == [False, False, False, False, True]


def test_line_kinds(column):
    lines = ["==12345== Memcheck", "==0== x", "==ab== x", "12345== x", "==12345=", "==12==", ""]
    assert column(tx.is_tool_line, lines) == [True, False, False, False, False, True, False]
    assert column(tx.pid, lines) == ["12345", None, None, None, None, "12", None]
    heads = ["40 bytes in 1 blocks are definitely lost", "1,024 bytes in 2 blocks", "bytes in 1 blocks", "8 bytes in 1 block"]
    assert column(tx.is_leak_head, heads) == [True, False, False, False]
    assert column(tx.has_unknown, ["??", "a???b", ""]) == [False, True, False]
    assert column(tx.has_at, ["at : x", "at 0x1: x"]) == [True, False]
    assert column(tx.has_by, ["by : x", "by x"]) == [True, False]


def test_leading_lines(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],)], "l array<string>")
    got = rows.select(tx.leading_lines(F.col("l"), 2), tx.leading_lines(F.col("l"), 0)).first()
    assert tuple(got) == ("a\nb", "a\nb\nc")


def test_custom_rules(column):
    rules = (("thread 1", "thread N"), (r"tid=\d+", "tid"))
    assert column(lambda t: tx.canonical(t, rules), [" thread 1  tid=99 0x1"]) == ["thread N tid 0x1"]


@pytest.mark.parametrize(
    "bad",
    [
        {"depth": -1}, {"depth": 1001}, {"depth": True}, {"depth": "1"}, {"marker": ""},
        {"marker": "x" * 1025}, {"marker": "a\0b"}, {"scope": "file"}, {"start_phrases": ()},
        {"start_phrases": ("",)}, {"chunk_bits": 1},
    ],
)
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        CleanOptions(**bad)


def test_numbers_as_text(column):
    texts = ["12", "-3", "1.5", "", "x7y8", "-", "99999999999999999999"]
    assert column(lambda t: vl.int_or_default(t, 5), texts) == [12, -3, 5, 5, 5, 5, 5]
    assert column(vl.int_or_zero, texts[:6]) == [12, 3, 15, 0, 78, 0]
    assert column(vl.count_text, texts) == [12, 0, 0, 0, 0, 0, 0]
    assert column(vl.kv_map, ["A=1\nno\nB=x=y\n\nA=2\nC="])[0] == {"A": "2", "B": "x=y", "C": ""}
