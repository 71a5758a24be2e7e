"""Texts against many regular expressions, by an index of literals.

Most expressions hold a literal that every match must contain. Texts are joined with these literals by anchored grams, the way texts meet
the terms of a lexicon, and an expression is only tried on texts that hold its literal. The plan has one join and one condition, however
many expressions there are. Expressions without such a literal are tried on every text, one condition each.

Where many expressions begin with a literal and go on alike, texts are scanned once for the common rest, and what stands before its places
is joined with the literals: no expression is compiled, and no text scanned, for each pair of them.
"""

from __future__ import annotations

import re
import re._constants as ops
import re._parser as regex
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import fits_broadcast, lookup_join, written
from . import terms as T

# Shorter literals are no help: too many texts hold them.
SHORTEST = 3
# Flags under which a literal is not found as it is written.
LOOSE = re.IGNORECASE | re.VERBOSE
# What so many expressions share behind their leading literals is scanned for, so many such rests at most.
SHARED, RESTS = 64, 64
# Longest leading literal that is told from the text before a place, and longest start of a rest that is tried at every place.
LONGEST, TRIED = 64, 256


def _parsed(pattern: str):
    """The expression, one of Java, as Python's parser reads it; None if it reads it in another way or not at all."""
    if re.search(r"\\[QERXGhHvVpPzZN0-9]|\(\?[a-zA-Z-]+[:)]|&&|\[\[", pattern):
        return None
    try:
        parsed = regex.parse(pattern)
    except (re.error, OverflowError, RecursionError, ValueError):
        return None
    return None if parsed.state.flags & LOOSE else parsed


def required_literal(pattern: str) -> str | None:
    """The longest string that every match of the expression contains, or None if none of ``SHORTEST`` characters is known.

    Expressions are those of Java. One that Python reads in another way or not at all has no known literal.
    """
    best = longest_literal(pattern)
    return best if len(best) >= SHORTEST else None


def longest_literal(pattern: str) -> str:
    """The longest string known to be in every match of the expression, of whatever length; empty if none is."""
    return _longest(_parsed(pattern))


def _longest(parsed) -> str:
    return max(_literals(parsed or ()), key=len, default="")


def _literals(parsed) -> Iterator[str]:
    """Strings that a match of the parsed expression contains, each as long as it can be told."""
    run = ""
    for op, value in parsed:
        if op is ops.LITERAL:
            run += chr(value)
            continue
        if op is ops.SUBPATTERN and not value[1] and not value[2]:
            # A group of literals goes on with the run around it.
            inner = list(value[3])
            if all(o is ops.LITERAL for o, _ in inner):
                run += "".join(chr(v) for _, v in inner)
                continue
        yield run
        run = ""
        if op is ops.SUBPATTERN and not value[1] and not value[2]:
            yield from _literals(value[3])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] >= 1:
            yield from _literals(value[2])
        elif op is ops.ATOMIC_GROUP:
            yield from _literals(value)
    yield run


def lead_and_rest(pattern: str) -> tuple[str, str] | None:
    """The literal that the expression begins with and the expression behind it, if a match is a place where the one ends and the
    other begins, and the second can be tried at every place of a text."""
    return _fallen(pattern, _parsed(pattern))


def _fallen(pattern: str, parsed) -> tuple[str, str] | None:
    units = re.match(r"(?:[^\\.\[\]{}()*+?^$|]|\\[^\w\s])*", pattern)[0]
    cut = re.findall(r"\\.|[^\\]", units, re.S)
    if pattern[len(units) : len(units) + 1] in tuple("*+?{"):
        cut = cut[:-1]
    lead, rest = "".join(u[-1] for u in cut), pattern[sum(map(len, cut)) :]
    if parsed is None or not SHORTEST <= len(lead) <= LONGEST:
        return None
    # Read apart, both must be what the whole is: an alternation, for one, is not.
    whole = [(ops.LITERAL, ord(c)) for c in lead] == list(parsed)[: len(lead)]
    return (lead, rest) if whole and _read(rest) == repr(list(parsed)[len(lead) :]) else None


@lru_cache(1000)
def _read(rest: str) -> str | None:
    """How a rest is read, if it is not empty and begins with something of bounded length that can't be."""
    parsed = None if re.search(r"\[\^?\]|\[[^\]]*\[", rest) else _parsed(rest)
    for i in range(len(parsed or ())):
        least, most = parsed[i : i + 1].getwidth()
        if most > TRIED:
            return None
        if least:
            return repr(list(parsed))
    return None


def with_literals(constraints: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Add ``literal``, NULL where an expression has none, and ``lead`` and ``rest``, both NULL where an expression does not fall into them."""

    def literals(patterns: pd.Series) -> pd.DataFrame:
        read = [(p, None if p is None else _parsed(p)) for p in patterns]
        found = [(_longest(r), *(r and _fallen(p, r) or (None, None))) for p, r in read]
        return pd.DataFrame([(l if len(l) >= SHORTEST else None, *parts) for l, *parts in found], columns=["literal", "lead", "rest"], dtype=object)

    found = constraints.withColumn("_l", F.pandas_udf(literals, "literal string, lead string, rest string")(F.col(pattern)))
    return found.select(*constraints.columns, "_l.*")


def hits(texts: DataFrame, constraints: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, constraint_id, penalty) for every text and every expression (constraint_id, pattern, penalty) with a match in it; rows may come
    more than once. A NULL text or pattern has no match. Literals are found here, unless :func:`with_literals` has added them."""
    known = constraints if "literal" in constraints.columns else with_literals(constraints.filter("pattern IS NOT NULL"))
    named = written(known.select("constraint_id", "pattern", "penalty", "literal", "lead", "rest"), "expressions")
    counted = named.filter("rest IS NOT NULL").groupBy("rest").agg(
        F.count("*").alias("n"), F.max(F.length("lead")).alias("longest"), F.collect_set(_width("lead")).alias("widths")
    )
    rests = counted.filter(F.col("n") >= SHARED).orderBy(F.desc("n"), "rest").limit(RESTS).collect()
    apart = named if not rests else named.filter(~F.coalesce(F.col("rest").isin([r["rest"] for r in rests]), F.lit(False)))
    found = [_behind(texts, named.filter(F.col("rest") == r["rest"]), r, key, text) for r in rests]
    if not rests or not apart.isEmpty():
        found.append(_tried(texts, apart, key, text))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _width(lead: str) -> Column:
    """Leads of 2^j .. 2^(j+1)-1 characters are anchored on their last 2^j."""
    return F.call_function("shiftleft", F.lit(1), F.length(F.bin(F.length(lead))) - 1).cast("int")


def _behind(texts: DataFrame, named: DataFrame, shared: Row, key: str, text: str) -> DataFrame:
    """Hits of expressions that are a ``lead`` with the same rest behind it; the longest lead and the widths of anchors are known."""
    rest, longest = shared["rest"], shared["longest"]
    # A text is cut at the places where the rest matches, not inside a pair of surrogates; it does not match at the end.
    cut = F.split(text, f"(?={rest})(?!\\p{{Cs}})", -1)
    pieces = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.transform(cut, lambda p: F.right(p, F.lit(longest))).alias("_p"))
    before = lambda i: F.array_join(F.slice("_p", F.greatest(i - (longest - 2), F.lit(1)), F.least(i + 1, F.lit(longest))), "")
    whole = F.transform("_p", lambda p, i: F.when(F.length(p) >= longest, p).otherwise(F.right(before(i), F.lit(longest))))
    windows = pieces.filter(F.size("_p") > 1).select("_key", whole.alias("_w"))
    windows = windows.select("_key", F.explode(F.array_distinct(F.slice("_w", F.lit(1), F.size("_w") - 1))).alias("_window"))
    own = named.select(F.right("lead", _width("lead")).alias("_anchor"), "lead", "constraint_id", "penalty")
    ends = [F.when(F.length("_window") >= w, F.right("_window", F.lit(w))) for w in sorted(shared["widths"])]
    probes = windows.select("_key", "_window", F.explode(F.array_compact(F.array(*ends))).alias("_anchor"))
    small = fits_broadcast(own)
    if not small:
        # The join reads them more than once.
        probes = written(T.maybe_in(probes, own, "_anchor"), "probes")
    found = lookup_join(probes, own, "_anchor", small=small).filter(F.endswith("_window", "lead"))
    return found.select(F.col("_key").alias(key), "constraint_id", "penalty")


def _tried(texts: DataFrame, named: DataFrame, key: str, text: str) -> DataFrame:
    """Hits of expressions that are tried on each text that holds their literal."""
    whole = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), T.text_hash(text).alias("_id"), F.col(text).alias("_body"))
    lex = T.lexicon(named.select(F.col("literal").alias("term")), T.ENFORCE, 0)
    # The distinct texts that hold a literal, with the literals; which expressions have it is looked up.
    held = T.hits(whole, lex, "_id", "_body")
    own = named.filter("literal IS NOT NULL").withColumnRenamed("literal", "term")
    tried = lookup_join(held, own, "term").groupBy("_id").agg(F.collect_list(F.struct("constraint_id", "pattern", "penalty")).alias("_c"))
    met = lookup_join(whole, written(tried, "tried"), "_id").select("_key", "_body", F.explode("_c").alias("_c"))
    return met.filter(F.expr("_body RLIKE _c.pattern")).select(F.col("_key").alias(key), "_c.constraint_id", "_c.penalty")
