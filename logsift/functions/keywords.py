"""Keyword patterns and what follows from their counts.

Patterns are matched without regard to case on text whose non-ASCII characters
have been replaced (`text.ascii_only`), line by line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsift.functions.text import ascii_only

_SPACE = r"[ \t\n\x0B\f\r]"

# Words announced in code comments.
COMMENT_WORDS = {
    "cli_breaking_keywords": r"CLI[- ]?BREAKING",
    "api_breaking_keywords": r"API[- ]?BREAKING",
    "new_feature_keywords": r"NEW[- ]?FEATURE",
    "security_keywords": r"SECURITY",
    "removed_options_keywords": rf"REMOVED{_SPACE}+OPTION(S)?",
    "added_options_keywords": rf"ADDED{_SPACE}+OPTION(S)?",
}

# Fixed value: how a comment begins, after an optional diff sign.
COMMENT_START = rf"(^|{_SPACE})[+-]?{_SPACE}*(//|/\*|#|--){_SPACE}*"

# Words in commit messages.
MESSAGE_WORDS = {
    "commit_cli_breaking": r"(CLI[- ]?BREAKING|BREAKING[^0-9A-Za-z]+.*CLI)",
    "commit_api_breaking": r"(API[- ]?BREAKING|BREAKING[^0-9A-Za-z]+.*API)",
    "commit_general_breaking": (
        rf"(BREAKING{_SPACE}+CHANGE|BREAKING[^0-9A-Za-z]+.*(CHANGE|MAJOR))"
    ),
    "commit_new_feature": (
        r"(NEW[- ]?FEATURE|FEATURE(S)?[^0-9A-Za-z]+.*(ADD(ED)?|INTRODUC(ED|ES)))"
    ),
    "commit_security": r"(SECURITY|VULNERABILIT(Y|IES)|CVE[- ]?[0-9]{4}-[0-9]+)",
}

# Word lists counted by occurrence.
SECURITY_WORDS = (
    r"\b(security|vuln(?:erab\w*)?|exploit|breach|attack|threat"
    r"|malware|virus|trojan|backdoor|rootkit|phishing|spam"
    r"|ddos|\bdo[sz]\b"
    r"|overflow|injection|xss|csrf|sqli|rce|ssrf|xxe"
    r"|privilege|escalation|bypass|circumvent"
    r"|mitigation|hardening|sandbox|policy"
    r"|auth(?:entication|orization)?|session(?:\s*hijack\w*)?"
    r"|crypto(?:graphy)?|encryption|decryption|tls|ssl|x\.509|certificate(?:\s*pinning)?"
    r"|secret|token|leak|expos(?:e|ure)"
    r"|path\s*traversal|directory\s*traversal)\b"
)
CVE_WORDS = r"\bCVE-[0-9]{4}-[0-9]{4,7}\b"
MEMORY_WORDS = (
    r"\b(buffer[- _]?overflow|stack[- _]?overflow|heap[- _]?overflow"
    r"|use[- _]?after[- _]?free|double[- _]?free"
    r"|null[- _]?pointer|dangling[- _]?pointer"
    r"|out[- _]?of[- _]?bounds|oob"
    r"|memory[- _]?leak|format[- _]?string|integer[- _]?overflow|signedness"
    r"|race[- _]?condition|data[- _]?race|deadlock)\b"
)
CRASH_WORDS = (
    r"\b(segfault|segmentation\s+fault|crash|abort|assert|panic"
    r"|fatal(?:\s+error)?|core\s+dump|stack\s+trace)\b"
)

# Weights of the security score, and where its bands begin.
SECURITY_WEIGHTS = {
    "security_keywords": 1,
    "security_patterns": 1,
    "cve_patterns": 3,
    "memory_safety_issues": 2,
    "crash_fixes": 1,
}
RISK_BANDS = (("high", 15), ("medium", 5), ("low", 1))


def line_has(line: Column, words: str) -> Column:
    return line.rlike(f"(?is){words}")


def comment_has(line: Column, words: str) -> Column:
    """Words right after the beginning of a comment."""
    return line_has(line, COMMENT_START + words)


def occurrences(line: Column, words: str) -> Column:
    """How often the words occur in a line of ASCII text, without overlap."""
    return F.regexp_count(line, F.lit(f"(?i){words}")).cast("long")


def is_security_text(text: Column) -> Column:
    return ascii_only(text).rlike(f"(?i){SECURITY_WORDS}")


def risk_band(score: Column) -> Column:
    (high, high_from), (medium, medium_from), (low, low_from) = RISK_BANDS
    return (
        F.when(score >= high_from, high)
        .when(score >= medium_from, medium)
        .when(score >= low_from, low)
        .otherwise("none")
    )
