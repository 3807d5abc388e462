"""Text helpers shared by the normalisers, the signals and the renderers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

# Markers of an error in tool output, matched without regard to case
# at the start of the text or after white space.
ERROR_MARKERS = (
    r"Traceback \(most recent call last\)",
    r"Error:",
    r"exit code [1-9]",
    r"command failed",
    r"failed with status [1-9]",
    r"SyntaxError",
    r"TypeError",
    r"ValueError",
    r"KeyError",
    r"ModuleNotFoundError",
    r"AttributeError",
    r"ImportError",
    r"RuntimeError",
    r"AssertionError",
)
ERROR_PATTERN = f"(?i)(?:^|{SPACE_CLASS})(?:{'|'.join(ERROR_MARKERS)})"

# Phrases with which an agent abandons its task; the apostrophe may be
# straight or curly.
APOSTROPHE = "['‘’]"
GIVE_UP_PHRASES = (
    "I (?:cannot|can't|am unable|am not able)",
    "I don't have (?:access|the ability)",
    "this (?:is beyond|isn't something I can)",
    "let me know how you'd like to proceed",
    "I'll stop here",
    "unable to complete",
    "I (?:apologize|am sorry),? (?:but )?I (?:cannot|can't)",
)
GIVE_UP_PATTERN = "(?i)(?:" + "|".join(GIVE_UP_PHRASES).replace("'", APOSTROPHE) + ")"

# Exit statuses that mean the context window ran out.
CONTEXT_EXIT_STATUSES = (
    "exit_context",
    "context_limit_exceeded",
    "context window exceeded",
    "maximum context length",
)
CONTEXT_EXIT_PATTERN = f"(?i)(?:{'|'.join(CONTEXT_EXIT_STATUSES)})"

ELLIPSIS = "…"
SIGNATURE_CHARS = 120


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    """True for NULL and for white space only."""
    return F.coalesce(strip(text) == "", F.lit(True))


def truncate(text: Column, cap: int, mark: str = ELLIPSIS) -> Column:
    """Strip, then cut to ``cap`` characters ending in an ellipsis."""
    bare = strip(text)
    return F.when(F.length(bare) <= cap, bare).otherwise(
        F.concat(rstrip(F.left(bare, F.lit(cap - 1))), F.lit(mark))
    )


def cut(text: Column, cap: int, mark: str) -> Column:
    """Like :func:`truncate` for text that is already trimmed at the front."""
    return F.when(F.length(text) <= cap, text).otherwise(
        F.concat(rstrip(F.left(text, F.lit(cap - 1))), F.lit(mark))
    )


def has_error_marker(text: Column, pattern: str = ERROR_PATTERN) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def gives_up(text: Column, pattern: str = GIVE_UP_PATTERN) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def sql_pattern(pattern: str) -> str:
    """A pattern of the SQL side for Java, with the word ends and case pairs it has there.

    To RE2 a word is of ASCII letters, digits and underscores, to Java of any letters; ``(?i)``
    pairs all letters in RE2, only ASCII ones in Java.
    """
    ends = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    return pattern.replace(r"\b", ends).replace("(?i)", "(?iu)")


def context_exhausted(exit_status: Column) -> Column:
    return F.coalesce(exit_status.rlike(CONTEXT_EXIT_PATTERN), F.lit(False))


def is_encrypted(reasoning: Column) -> Column:
    """True for the placeholders that stand for withheld reasoning."""
    return F.coalesce(reasoning.startswith("[encrypted "), F.lit(False))


def text_hash(text: Column) -> Column:
    """Staleness key of a derived text."""
    return F.sha2(text, 256)


def call_key(name: Column, arguments: Column) -> Column:
    """One key per (function, arguments); ``arguments`` is canonical JSON text."""
    return F.concat(
        F.lit("tc::"), F.coalesce(name, F.lit("")), F.lit("::"), F.coalesce(arguments, F.lit("null"))
    )


def message_key(message: Column, chars: int = SIGNATURE_CHARS) -> Column:
    lead = F.lower(F.left(strip(message), F.lit(chars)))
    return F.when(lead != "", F.concat(F.lit("msg::"), lead))


def step_signature(tool_calls: Column, message: Column, chars: int = SIGNATURE_CHARS) -> Column:
    """What a step does: its first call, else the lead of its message, else NULL."""
    first = F.get(tool_calls, F.lit(0))
    return F.when(
        first.isNotNull(), call_key(first["function_name"], first["arguments"])
    ).otherwise(message_key(message, chars))


def step_error_text(results: Column, message: Column, pattern: str = ERROR_PATTERN) -> Column:
    """First result with an error marker, else the message if it has one, else NULL."""
    bad = F.get(F.filter(results, lambda r: has_error_marker(r["content"], pattern)), F.lit(0))
    return F.coalesce(
        bad["content"], F.when(has_error_marker(message, pattern), message)
    )


def contains_ci(columns: list[Column], needle: str) -> Column:
    """Substring test as SQL LIKE does it: ASCII case folded, ``%`` and ``_`` are wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = needle.translate(str.maketrans(upper, lower)).replace("\\", "\\\\")
    tests = [F.translate(c, upper, lower).like(f"%{folded}%") for c in columns]
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found
