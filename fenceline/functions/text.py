"""Scalar text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sequence end markers that may stand before an answer.
END_MARKERS = ("</s>", "<|end_of_text|>")
# Characters tokenizers use for white space.
WHITE_SPACE = (
    " ",
    "\u2581",
    "\u0120",
    "\u00a0",
    "\u202f",
    "\u2009",
    "\u200b",
    "\u2060",
    "\t",
    "\n",
    "\r",
)
# Characters that may stand for the space at the start of a piece.
SPACE_MARKERS = (" ", "\u2581", "\u0120", "\u00a0")
# Words whose leading space shows the marker.
MARKER_WORDS = ("the", "and")


def quote(literal: str) -> str:
    """``literal`` as a regular expression (same escapes in Java and RE2)."""
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c for c in literal)


# White space as Python's ``str.strip`` and ``\\s`` see it: Unicode plus four separators.
WS = r"[\s\x1c-\x1f]"


def rstrip(c: Column) -> Column:
    # The look-behind keeps long inner runs of white space from being rescanned.
    return F.regexp_replace(c, rf"(?U)(?<!{WS}){WS}+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{WS}+", "")


def strip(c: Column) -> Column:
    return rstrip(lstrip(c))


def norm(c: Column) -> Column:
    return F.translate(F.lower(strip(c)), "-.", "__")


def after(text: Column, prefix: Column) -> Column:
    return F.substring(text, F.length(prefix) + 1, F.length(text))


def strip_prompt(prompt: Column, answer: Column) -> Column:
    """The answer without the prompt it repeats, looking behind leading end markers."""
    cleaned = answer
    for marker in END_MARKERS:
        cleaned = F.regexp_replace(cleaned, rf"(?U)\A(?:{WS}*{quote(marker)}{WS}*)+", "")
    trimmed, short = lstrip(cleaned), rstrip(prompt)
    return (
        F.when((prompt == "") | (answer == ""), answer)
        .when(F.startswith(answer, prompt), after(answer, prompt))
        .when(F.startswith(trimmed, short), after(trimmed, short))
        .otherwise(cleaned)
    )


def canonical_space(c: Column) -> Column:
    """Every white-space character of the tokenizers' alphabet as a plain space."""
    return F.translate(c, "".join(WHITE_SPACE), " " * len(WHITE_SPACE))


def with_marker(term: Column, marker: Column) -> Column:
    return F.replace(term, F.lit(" "), marker)


def text_or_empty(record: Column) -> Column:
    """``record.text`` with "" for a missing text inside a present record."""
    return F.when(record.isNotNull(), F.coalesce(record["text"], F.lit("")))
