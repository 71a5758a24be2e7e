"""Filters, spans and counts of forbidden patterns in text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

# Matches of a text whose offsets are summed up together.
CHUNK = 256


def eligible(docs: DataFrame, text: str = "text", patterns=P.PII) -> DataFrame:
    """Documents with a match whose prompt (text before it) has a usable length."""
    body = F.col(text)
    cut = F.instr(body, F.regexp_extract(body, P.scan(patterns), 0)) - 1
    # Through the array the cut is computed once for both bounds, and only behind a match.
    fits = F.exists(F.array(cut), lambda n: n.between(P.MIN_PROMPT, P.MAX_PROMPT))
    return docs.filter(P.has_match(body, patterns) & fits)


def violating(docs: DataFrame, text: str = "text", patterns=P.PII) -> DataFrame:
    return docs.filter(P.has_match(F.col(text), patterns))


def clean(docs: DataFrame, text: str = "text", patterns=P.PII) -> DataFrame:
    """Documents without a match; a NULL text has none."""
    return docs.filter(~F.coalesce(P.has_match(F.col(text), patterns), F.lit(False)))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", patterns=P.PII) -> DataFrame:
    """One row per non-overlapping leftmost match: its ordinal, offsets (0-based) and text."""
    body = F.col(text)
    # A text falls into matches and the gaps between them; their lengths add up to the offsets. Sums run
    # over chunks of matches first, then inside a chunk, so that no array is copied once per match.
    gaps = F.split(body, P.scan(patterns), -1)
    parts = F.zip_with(
        P.all_matches(body, patterns),
        gaps,
        lambda span, gap: F.when(span.isNotNull(), F.struct(F.length(gap).alias("gap"), span.alias("span"))),
    )
    found = docs.filter(P.has_match(body, patterns)).select(key, F.array_compact(parts).alias("_p"))
    last = F.floor((F.size("_p") - 1) / CHUNK).cast("int")
    chunks = found.filter(F.size("_p") > 0).select(
        key,
        F.transform(F.sequence(F.lit(0), last), lambda c: F.slice("_p", c * CHUNK + 1, F.lit(CHUNK))).alias("_c"),
    )

    def width(part):
        return part["gap"] + F.length(part["span"])

    total = F.transform("_c", lambda c: F.aggregate(c, F.lit(0), lambda n, part: n + width(part)))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("all"))
    starts = F.aggregate(
        total,
        none,
        lambda acc, n: F.struct((acc["end"] + n).alias("end"), F.concat(acc["all"], F.array(acc["end"])).alias("all")),
        lambda acc: acc["all"],
    )
    placed = chunks.select(key, F.posexplode(F.arrays_zip(F.col("_c").alias("c"), starts.alias("s"))).alias("_no", "_z"))

    def advance(acc, part):
        start = acc["end"] + part["gap"]
        end = start + F.length(part["span"])
        here = F.struct(start.alias("start"), end.alias("end"), part["span"].alias("span"))
        return F.struct(end.alias("end"), F.concat(acc["spans"], F.array(here)).alias("spans"))

    empty = F.struct(
        F.col("_z.s").alias("end"), F.array().cast("array<struct<start: int, end: int, span: string>>").alias("spans")
    )
    return placed.select(
        key, "_no", F.posexplode(F.aggregate("_z.c", empty, advance, lambda acc: acc["spans"])).alias("_i", "_s")
    ).select(key, (F.col("_no") * CHUNK + F.col("_i")).alias("ord"), "_s.start", "_s.end", "_s.span")


def distinct_spans(docs: DataFrame, text: str = "text", patterns=P.PII) -> DataFrame:
    """Distinct matched texts in code-point order."""
    return (
        docs.filter(P.has_match(F.col(text), patterns))
        .select(F.explode(P.all_matches(F.col(text), patterns)).alias("span"))
        .distinct()
        .orderBy("span")
    )


def count_by_reason(docs: DataFrame, text: str = "text", patterns=P.PII) -> DataFrame:
    return docs.groupBy(P.first_reason(F.col(text), patterns).alias("reason")).agg(F.count("*").alias("n_docs"))
