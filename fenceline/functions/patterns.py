"""Forbidden regular expressions and the column expressions built on them.

Only patterns without anchors, word boundaries and look-around are accepted: offsets are
found by locating the matched text, and an earlier occurrence of the same text would then
be an earlier match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four patterns, in the order in which reasons are reported.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PHONE = r"[0-9]{3}-[0-9]{3}-[0-9]{4}"
CARD = r"[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}"
# End of text in Java and Python alike ("$" also matches before a final line break).
END = r"(?![\s\S])"
# Inclusive bounds of a usable prompt, in characters.
MIN_PROMPT, MAX_PROMPT = 20, 2000


@dataclass(frozen=True)
class Pattern:
    """A forbidden pattern.

    ``completing`` matches the shortest text that completes a match of ``regex`` and ends
    with its completing character. It needs no repetition before the first fixed character,
    so it scans in linear time also over long runs of characters that could start a match.
    ``hint`` is a cheap expression every match contains. ``scanning`` finds the same matches as ``regex``, one
    after the other, in linear time; without it ``regex`` is linear itself.

    ``reach`` is how many characters before the completing one a shortest match can take.
    A pattern with an unbounded middle part names it by three more expressions: ``opened``
    (text that ends inside the middle part), ``filler`` (text wholly made of it) and
    ``closing`` (from inside the middle part to the completing character).
    """

    name: str
    regex: str
    completing: str
    reach: int
    hint: str | None = None
    scanning: str | None = None
    opened: str | None = None
    filler: str | None = None
    closing: str | None = None


PII = (
    Pattern(
        "email",
        EMAIL,
        completing=r"[a-zA-Z0-9._%+-]@[a-zA-Z0-9.-]+?\.[a-zA-Z]{2}",
        reach=5,
        hint="@",
        # A match starts where its run of characters does, or where the last match ended inside the run;
        # the run is never shortened, as no character of it is an @.
        scanning=r"(?:(?<![a-zA-Z0-9._%+-])|\G)[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
        opened=r"[a-zA-Z0-9._%+-]@[a-zA-Z0-9.-]*" + END,
        filler=r"^[a-zA-Z0-9.-]*" + END,
        closing=r"^@?[a-zA-Z0-9.-]+?\.[a-zA-Z]{2}",
    ),
    Pattern("ssn", SSN, completing=SSN, reach=10, hint="[0-9]-[0-9]"),
    Pattern("phone", PHONE, completing=PHONE, reach=11, hint="[0-9]-[0-9]"),
    Pattern("card", CARD, completing=CARD, reach=18, hint="[0-9]-[0-9]"),
)


def alternation(patterns=PII) -> str:
    return "|".join(p.regex for p in patterns)


def scan(patterns=PII) -> str:
    """Finds the same matches as :func:`alternation`, in linear time."""
    return "|".join(p.scanning or p.regex for p in patterns)


def probe(patterns=PII) -> str:
    """Matches the same texts as :func:`alternation`, without its repeated prefixes."""
    return "|".join(p.completing for p in patterns)


def _hinted(text: Column, patterns) -> Column | None:
    """A cheap necessary condition of a match, evaluated before the alternation."""
    hints = list(dict.fromkeys(p.hint for p in patterns))
    if None in hints:
        return None
    tests = [F.contains(text, F.lit(h)) if h.isalnum() or h == "@" else text.rlike(h) for h in hints]
    condition = tests[0]
    for test in tests[1:]:
        condition = condition | test
    return condition


def has_match(text: Column, patterns=PII) -> Column:
    found, hinted = text.rlike(probe(patterns)), _hinted(text, patterns)
    return found if hinted is None else hinted & found


def leftmost(text: Column, patterns=PII) -> Column:
    """Text of the leftmost match of the alternation, NULL without one."""
    found = F.regexp_extract(text, scan(patterns), 0)
    return F.when(has_match(text, patterns), found)


def prompt_cut(text: Column, patterns=PII) -> Column:
    """Text before the leftmost match, NULL without one."""
    return F.left(text, F.instr(text, leftmost(text, patterns)) - 1)


def usable_prompt(prompt: Column) -> Column:
    return F.length(prompt).between(MIN_PROMPT, MAX_PROMPT)


def first_reason(text: Column, patterns=PII) -> Column:
    """``match:<regex>`` of the first pattern in list order that occurs, else ``ok``."""
    reason = F.lit("ok")
    for p in reversed(patterns):
        reason = F.when(text.rlike(p.completing), F.lit("match:" + p.regex)).otherwise(reason)
    hinted = _hinted(text, patterns)
    return reason if hinted is None else F.when(hinted, reason).otherwise(F.lit("ok"))


def all_matches(text: Column, patterns=PII) -> Column:
    """Non-overlapping leftmost matches in order; an empty array without one."""
    found = F.regexp_extract_all(text, F.lit(f"({scan(patterns)})"), F.lit(1))
    return F.when(has_match(text, patterns), found).otherwise(F.array().cast("array<string>"))


def completion_end(text: Column, pattern: Pattern) -> Column:
    """Number of characters up to and including the one that first completes ``pattern``."""
    found = F.regexp_extract(text, pattern.completing, 0)
    return F.when(found != "", F.instr(text, found) - 1 + F.length(found))


def first_completion(text: Column, patterns=PII) -> Column:
    """Earliest completion over all patterns, NULL without one."""
    ends = [completion_end(text, p) for p in patterns]
    earliest = F.least(*ends) if len(ends) > 1 else ends[0]
    return F.when(has_match(text, patterns), earliest)


def clean_prefix(text: Column, patterns=PII) -> Column:
    """Text up to, not including, the character that completes the first violation."""
    return F.coalesce(F.left(text, first_completion(text, patterns) - 1), text)


def redact(text: Column, placeholder: str = "[PII]", patterns=PII) -> Column:
    edited = F.regexp_replace(text, scan(patterns), placeholder.replace("\\", "\\\\").replace("$", "\\$"))
    return F.when(has_match(text, patterns), edited).otherwise(text)
