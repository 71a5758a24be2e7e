"""Constraint tables: adding a row adds a constraint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import lookup_join, written
from . import regex_index
from . import terms as T

# (constraint_id, ord, kind 'term'|'regex', pattern, penalty). A table may have a column match_mode (ENFORCE,
# SELECT or EVAL), which says how a term is compared; without it, or with NULL, terms are compared by ENFORCE.
CONSTRAINTS = "constraint_id STRING, ord INT, kind STRING, pattern STRING, penalty DOUBLE"
MODES = (T.ENFORCE, T.SELECT, T.EVAL)
# Checks that one array of conditions holds; more of them take more arrays.
CHECKS_AT_ONCE = 64
# Up to this many regular expressions are one condition each; more are found by their literals.
LISTED_EXPRESSIONS = 64


def _rows(constraints: DataFrame) -> DataFrame:
    """The table with its rules for NULLs: a NULL penalty is 0, a NULL mode is ENFORCE."""
    mode = F.col("match_mode") if "match_mode" in constraints.columns else F.lit(None).cast("string")
    return constraints.withColumns(
        {"penalty": F.coalesce("penalty", F.lit(0.0)), "match_mode": F.coalesce(mode, F.lit(T.ENFORCE))}
    )


def hits(texts: DataFrame, constraints: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (key, constraint_id, penalty) of the constraints that the texts of a key violate."""
    checks, term_rows, regex_rows = _checks(constraints, F.col(text))
    found = _flagged(texts, checks, key)
    if regex_rows is not None:
        found = found.unionByName(regex_index.hits(texts, regex_rows, key, text))
    if term_rows is None:
        return found.distinct()
    for mode in MODES:
        own = term_rows.filter(F.col("match_mode") == mode)
        lex = T.lexicon(own.select(F.col("pattern").alias("term")), mode)
        named = own.select(T.as_term(F.col("pattern"), mode).alias("term"), "constraint_id", "penalty")
        by_term = lookup_join(T.hits(texts, lex, key, text), named, "term")
        found = found.unionByName(by_term.select(key, "constraint_id", "penalty"))
    return found.distinct()


def with_penalty(
    texts: DataFrame, constraints: DataFrame, text: str = "text", out: str = "penalty"
) -> DataFrame:
    """Add ``out``: the summed penalties of the violated constraints, 0 without one. A table of few
    constraints is one expression and needs neither a join nor a shuffle; a larger one is joined by
    the hash of the text."""
    checks, term_rows, regex_rows = _checks(constraints, F.col(text))
    if term_rows is None and regex_rows is None:
        total = F.lit(0.0)
        for row, hit in checks:
            total = total + F.when(hit, F.lit(row["penalty"])).otherwise(F.lit(0.0))
        return texts.withColumn(out, total)
    hashed = texts.select(T.text_hash(text).alias("_hash"), F.col(text).alias("_text"))
    summed = merged(hashed, constraints, "_hash", "_text").select("_hash", F.col("penalty").alias("_p"))
    joined = lookup_join(texts.withColumn("_hash", T.text_hash(text)), written(summed, "penalties"), "_hash", "left")
    return joined.withColumn(out, F.coalesce("_p", F.lit(0.0))).drop("_p", "_hash")


def _checks(constraints: DataFrame, body: Column) -> tuple[list, DataFrame | None, DataFrame | None]:
    """(row, condition) of the constraints tested row by row, and the term rows and the expressions left for a join."""
    table = _rows(constraints)
    term_rows, regex_rows = table.filter("kind = 'term'"), table.filter("kind = 'regex'")
    few = regex_rows.limit(LISTED_EXPRESSIONS + 1).collect()
    if len(few) > LISTED_EXPRESSIONS:
        regex_rows = written(regex_index.with_literals(regex_rows), "expressions")
        few, regex_rows = regex_rows.filter("literal IS NULL").collect(), regex_rows.filter("literal IS NOT NULL")
    else:
        regex_rows = None
    checks = [(r, _matches(body, r["pattern"])) for r in sorted(few, key=lambda r: r["ord"] or 0)]
    few = term_rows.filter("pattern <> ''").limit(T.LISTED_TERMS + 1).collect()
    if len(few) > T.LISTED_TERMS:
        return checks, term_rows, regex_rows
    return [(r, T.holds(body, F.lit(r["pattern"]), r["match_mode"])) for r in few] + checks, None, regex_rows


def _matches(body: Column, pattern: str | None) -> Column:
    """Whether a text has a match; a literal that every match contains is looked for first."""
    literal = regex_index.longest_literal(pattern) if pattern else ""
    return F.contains(body, F.lit(literal)) & body.rlike(pattern) if literal else body.rlike(pattern)


def _flagged(texts: DataFrame, checks: list, key: str) -> DataFrame:
    entries = [
        F.when(hit, F.struct(F.lit(r["constraint_id"]).alias("constraint_id"), F.lit(r["penalty"]).alias("penalty")))
        for r, hit in checks
    ]
    kind = "array<struct<constraint_id: string, penalty: double>>"
    parts = [entries[i : i + CHECKS_AT_ONCE] for i in range(0, len(entries), CHECKS_AT_ONCE)]
    tables = [F.array_compact(F.array(*part)).cast(kind) for part in parts] or [F.array().cast(kind)]
    return texts.select(key, F.explode(F.concat(*tables)).alias("_c")).select(key, "_c.*")


def merged(texts: DataFrame, constraints: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_violated, penalty): per violating text, its violated constraints counted and their
    penalties summed, each constraint once."""
    return (
        hits(texts, constraints, key, text)
        .groupBy(key)
        .agg(F.count("*").alias("n_violated"), F.sum("penalty").alias("penalty"))
    )
