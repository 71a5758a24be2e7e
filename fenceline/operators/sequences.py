"""Forbidden matches in token tables, across token boundaries.

A sequence is never collected whole. Its tokens are grouped into blocks of consecutive
positions, each with a halo of preceding tokens long enough for every bounded match. A match
with an unbounded middle part (an email domain) is followed across blocks by one flag per
block; only blocks that end inside such a match, or consist of its characters, take part.

Positions must be dense from 0 within a sequence (``running.position`` makes them so) and
pieces must not be empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..session import lookup_join, written
from . import terms as T
from .running import running_sum

BLOCK = 1024


def generated(tokens: DataFrame) -> DataFrame:
    """Only generated tokens advance the matching."""
    return tokens.filter(~F.col("is_prompt"))


def until_end(tokens: DataFrame) -> DataFrame:
    """Tokens up to and including the first end marker of their sequence."""
    ends = tokens.filter("is_eos").groupBy("seq_id").agg(F.min("pos").alias("_end"))
    kept = lookup_join(tokens, ends, "seq_id", "left")
    return kept.filter("_end IS NULL OR pos <= _end").drop("_end")


def blocks(tokens: DataFrame, halo: int, block: int = BLOCK) -> DataFrame:
    """(seq_id, block, tokens, text, halo_len): consecutive tokens with their halo."""
    block = max(block, halo)
    own = F.floor(F.col("pos") / block)
    homes = F.array(F.struct(own.alias("block"), F.lit(False).alias("is_halo")))
    if halo:
        next_home = F.array(F.struct((own + 1).alias("block"), F.lit(True).alias("is_halo")))
        homes = F.when(F.col("pos") % block >= block - halo, F.concat(homes, next_home)).otherwise(homes)
    placed = tokens.select("seq_id", "pos", "piece", F.explode(homes).alias("_h")).select(
        "seq_id", "pos", "piece", "_h.*"
    )
    return (
        placed.groupBy("seq_id", "block")
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("tokens"),
            F.coalesce(F.sum(F.when(F.col("is_halo"), F.length("piece"))), F.lit(0)).alias("halo_len"),
            F.bool_and("is_halo").alias("_only_halo"),
        )
        .filter("NOT _only_halo")
        .select("seq_id", "block", "tokens", F.array_join(F.col("tokens")["piece"], "").alias("text"), "halo_len")
    )


def first_completions(tokens: DataFrame, patterns=P.PII, block: int = BLOCK) -> DataFrame:
    """(seq_id, pattern, pos): the token that completes the first match of each pattern."""
    text, halo_len = F.col("text"), F.col("halo_len")
    own = F.substring(text, halo_len + 1, F.length(text))

    def entry(p: P.Pattern):
        late, out = F.lit(None).cast("int"), F.lit(False)
        if p.opened:
            closed_at = F.length(F.regexp_extract(text, p.closing, 0))
            late = F.when(closed_at > halo_len, closed_at)
            # NULL hands the flag of the preceding block on.
            out = F.when(text.rlike(p.opened), True).when(~own.rlike(p.filler), False)
        return F.struct(
            F.lit(p.name).alias("pattern"),
            F.lit(p.opened is not None).alias("linked"),
            P.completion_end(text, p).alias("end"),
            late.alias("late"),
            out.alias("out"),
        )

    # A block that completes nothing and is closed at its end only stops the flag: leaving it out
    # makes a gap in the block numbers.
    table = F.filter(
        F.array(*[entry(p) for p in patterns]),
        lambda e: e["end"].isNotNull() | e["late"].isNotNull() | F.coalesce(e["out"], F.lit(True)),
    )
    entries = (
        blocks(tokens, max(p.reach for p in patterns), block)
        .select("seq_id", "block", "tokens", F.explode(table).alias("_e"))
        .select("seq_id", "block", "tokens", "_e.*")
        .select(
            "seq_id",
            "block",
            "pattern",
            "out",
            F.when(~F.col("linked"), F.col("block")).alias("_free"),
            _token_at("end").alias("pos"),
            _token_at("late").alias("late_pos"),
        )
    )
    # Entries of bounded patterns need no chain and stay spread by block.
    chain = Window.partitionBy("seq_id", "pattern", "_free").orderBy("block")
    run = Window.partitionBy("seq_id", "pattern", "_free", "_run").orderBy("block")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    return (
        entries.withColumn("_run", F.col("block") - F.row_number().over(chain))
        .withColumn("_in", F.last("out", ignorenulls=True).over(before))
        .select("seq_id", "pattern", F.least("pos", F.when(F.col("_in"), F.col("late_pos"))).alias("pos"))
        .groupBy("seq_id", "pattern")
        .agg(F.min("pos").alias("pos"))
        .filter("pos IS NOT NULL")
    )


def _token_at(end: str):
    """Position of the token of a block that holds its ``end``-th character."""

    def walk(acc, token):
        length = acc["length"] + F.length(token["piece"])
        reached = acc["pos"].isNull() & (length >= F.col(end))
        return F.struct(length.alias("length"), F.when(reached, token["pos"]).otherwise(acc["pos"]).alias("pos"))

    start = F.struct(F.lit(0).alias("length"), F.lit(None).cast("bigint").alias("pos"))
    walked = F.aggregate("tokens", start, walk, lambda acc: acc["pos"])
    return F.when(F.col(end).isNotNull(), walked)


def first_term_completions(tokens: DataFrame, lex: T.Lexicon, block: int = BLOCK) -> DataFrame:
    """(seq_id, pattern, pos) of the first forbidden term, for a lexicon of any size."""
    if lex.literals is not None:
        if not lex.literals:
            return tokens.select("seq_id", F.lit("terms").alias("pattern"), F.col("pos").cast("bigint")).limit(0)
        return first_completions(tokens, (T.term_pattern(lex),), block)
    longest = lex.terms.agg(F.max(F.length("term"))).first()[0]
    # Tokens are grouped once; the blocks are scanned and then looked up.
    cut = written(blocks(tokens, longest - 1, block), "blocks")
    ends = (
        T.occurrences(cut, lex, ["seq_id", "block"])
        .groupBy("seq_id", "block")
        .agg(F.min(F.col("start") + F.length("term")).alias("end"))
    )
    found = cut.join(ends, ["seq_id", "block"]).select("seq_id", _token_at("end").alias("pos"))
    return found.groupBy("seq_id", F.lit("terms").alias("pattern")).agg(F.min("pos").alias("pos"))


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Add ``start`` and ``end`` character offsets of every token within its sequence."""
    length = F.length("piece")
    return running_sum(tokens, ["seq_id"], "pos", length, "start").withColumn("end", F.col("start") + length)


def overlapping(tokens: DataFrame, spans: DataFrame, width: int = 1024) -> DataFrame:
    """Tokens joined with the spans they overlap (both with ``start``, ``end``), by equality on
    (sequence, bin) instead of on the sequence alone."""
    left = _binned(tokens, "token", width)
    # There are far fewer spans than tokens: looked up, they spare the tokens a shuffle.
    right = written(_binned(spans, "span", width), "binned")
    t, s = F.col("token"), F.col("span")
    # A pair that shares several bins is kept in the first of them.
    first_shared = F.floor(F.greatest(t["start"], s["start"]) / width)
    return lookup_join(left, right, ["seq_id", "_bin"]).filter(
        (t["start"] < s["end"]) & (s["start"] < t["end"]) & (F.col("_bin") == first_shared)
    ).select("seq_id", "token", "span")


def _binned(df: DataFrame, name: str, width: int) -> DataFrame:
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    return df.select(
        "seq_id", F.struct(*[c for c in df.columns if c != "seq_id"]).alias(name), F.explode(bins).alias("_bin")
    )
