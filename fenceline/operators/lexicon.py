"""Lexicon states, vocabulary tables and their masks, as joins on text.

A state is the prefix of a term that has been read; its name is that prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import MARKER_WORDS, SPACE_MARKERS
from ..session import fits_broadcast, lookup_join, written
from . import terms as T


def _prefixes(text: Column, low: int | Column, high: Column) -> Column:
    return F.when(high >= low, F.transform(F.sequence(F.lit(low), high), lambda i: F.left(text, i)))


def _suffixes(text: Column, low: int | Column, high: Column) -> Column:
    return F.when(high >= low, F.transform(F.sequence(F.lit(low), high), lambda i: F.right(text, i)))


def states(terms: DataFrame) -> DataFrame:
    """(state, depth): all prefixes of all terms, the empty one included."""
    term = F.col("term")
    return (
        terms.select(F.explode(_prefixes(term, 0, F.length(term))).alias("state"))
        .distinct()
        .withColumn("depth", F.length("state"))
    )


def failure_links(terms: DataFrame) -> DataFrame:
    """(state, failure): the longest proper suffix of a state that is a state as well."""
    nodes = states(terms)
    state = F.col("state")
    proper = nodes.select("state", F.explode(_suffixes(state, 1, F.col("depth") - 1)).alias("suffix"))
    linked = lookup_join(proper, nodes.select(state.alias("suffix")), "suffix", "left_semi")
    # The empty suffix is always a state; adding it here keeps it out of the join.
    rooted = nodes.filter("depth > 0").select("state", F.lit("").alias("suffix"))
    longest = linked.select("state", "suffix").unionByName(rooted).groupBy("state").agg(
        F.max(F.length("suffix")).alias("n")
    )
    return longest.select("state", F.right("state", F.col("n")).alias("failure"))


def forbidden_states(terms: DataFrame) -> DataFrame:
    """States that end with a whole term."""
    nodes = states(terms)
    ends = nodes.select("state", F.explode(_suffixes(F.col("state"), 1, F.col("depth"))).alias("term"))
    return lookup_join(ends, terms.select("term").distinct(), "term", "left_semi").select("state").distinct()


def state_table(
    terms: DataFrame, vocabulary: DataFrame, end_piece: str | None = None, literal_terms: int = T.LITERAL_TERMS
) -> DataFrame:
    """(state, piece, next_state, blocked) for every violation-free state and every piece, sparse.

    Each piece has a row for the empty state. A pair that is not listed behaves like that row:
    what a piece does is the same in every state unless a term, or a longer state, straddles the
    start of the piece, and those pairs are found by equality of the two parts. ``next_state`` is
    NULL where the pair is blocked. ``end_piece`` is never blocked.
    """
    term, state, piece = F.col("term"), F.col("state"), F.col("piece")
    lex = T.lexicon(T.minimal_terms(terms, literal_terms), T.ENFORCE, literal_terms)
    minimal = lex.terms
    nodes = written(T.without(states(terms), lex, text="state").select("state"), "states")
    pieces = vocabulary.select("piece").filter(piece != "").distinct()
    scanned = pieces if end_piece is None else pieces.filter(piece != end_piece)
    clean = T.without(scanned, lex, text="piece")

    # What a piece does on its own: a term inside it, else the longest suffix that is a state.
    inside = F.col("_inside") if end_piece is None else F.col("_inside") & (piece != end_piece)
    alone = _add_longest(pieces, nodes, "piece", "_alone", literal_terms)
    root = T.flagged(alone, lex, "_inside", text="piece").select(
        F.lit("").alias("state"),
        "piece",
        F.when(~inside, F.col("_alone")).alias("next_state"),
        inside.alias("blocked"),
    )

    # Suffixes a state can lend to the start of a straddling match.
    lent = nodes.select("state", F.explode(_suffixes(state, 1, F.length("state"))).alias("head"))

    def split(text: Column) -> Column:
        cuts = F.sequence(F.lit(1), F.length(text) - 1)
        parts = F.transform(
            cuts,
            lambda i: F.struct(
                F.left(text, i).alias("head"), F.substring(text, i + 1, F.length(text)).alias("tail")
            ),
        )
        return F.when(F.length(text) > 1, parts)

    # Pieces meet the remainders first and states second, so every joined pair is a result row.
    term_parts = minimal.select(F.explode(split(term)).alias("_p")).select("_p.*")
    reach = minimal.agg(F.max(F.length("term"))).first()[0] or 0
    starts = clean.select(
        "piece",
        F.explode(_prefixes(piece, 1, F.least(F.length("piece"), F.lit(reach)))).alias("tail"),
    )
    completing = lookup_join(starts, term_parts, "tail").select("head", "piece")
    blocked = lookup_join(completing, lent, "head").select("state", "piece").distinct()

    node_parts = nodes.select(F.explode(split(state)).alias("_p")).select("_p.head", F.col("_p.tail").alias("piece"))
    grown = clean if end_piece is None else clean.unionByName(pieces.filter(piece == end_piece))
    growing = lookup_join(grown, node_parts, "piece")
    longer = (
        lookup_join(growing, lent, "head")
        .groupBy("state", "piece")
        .agg(F.max(F.length("head") + F.length("piece")).alias("n"))
    )
    special = (
        blocked.withColumn("_hit", F.lit(True))
        .join(longer, ["state", "piece"], "full")
        .select(
            "state",
            "piece",
            F.when(F.col("_hit").isNull(), F.right(F.concat("state", "piece"), F.col("n"))).alias("next_state"),
            F.coalesce("_hit", F.lit(False)).alias("blocked"),
        )
    )
    return root.unionByName(special)


def _add_longest(texts: DataFrame, nodes: DataFrame, text: str, out: str, literal_terms: int) -> DataFrame:
    """Add ``out``: the longest suffix of a text among ``nodes.state`` (which holds the empty one)."""
    body, lex = F.col(text), T.lexicon(nodes.select(F.col("state").alias("term")), T.ENFORCE, literal_terms)
    if lex.literals is not None:
        # The leftmost match that reaches the end is the longest suffix.
        reach = max(map(len, lex.literals), default=0)
        ending = T.any_of(lex.literals) + P.END if lex.literals else P.END
        return texts.withColumn(out, F.regexp_extract(F.right(body, F.lit(reach)), ending, 0))
    reach = lex.terms.agg(F.max(F.length("term"))).first()[0]
    ends = texts.select(text).distinct().select(
        text, F.explode(_suffixes(body, 1, F.least(F.length(body), F.lit(reach)))).alias("term")
    )
    found = lookup_join(ends, lex.terms, "term", "left_semi").groupBy(text).agg(F.max(F.length("term")).alias("_n"))
    longest = texts.join(found, text, "left").withColumn(out, F.right(body, F.coalesce("_n", F.lit(0))))
    return longest.drop("_n")


def state_of(
    texts: DataFrame, terms: DataFrame, text: str = "text", literal_terms: int = T.LITERAL_TERMS
) -> DataFrame:
    """Add ``state``: the longest suffix of a text that is a state. The text must hold no term."""
    return _add_longest(texts, states(terms), text, "state", literal_terms)


def with_mask(candidates: DataFrame, table: DataFrame, end_piece: str | None = None) -> DataFrame:
    """Add ``blocked`` and ``next_state`` to candidates (state, piece) from a :func:`state_table`.

    A pair without a row of its own takes the row of the piece; a piece outside the vocabulary is
    not blocked.
    """
    own = table.filter("state <> ''").select(
        "state", "piece", F.struct("blocked", "next_state").alias("_own")
    )
    root = table.filter("state = ''").select("piece", F.struct("blocked", "next_state").alias("_root"))
    taken = F.coalesce("_own", "_root")
    # A lookup join beyond the broadcast bound reads its facts several times: what the first one gives is then a table.
    small = fits_broadcast(own)
    joined = lookup_join(candidates, own, ["state", "piece"], "left", small=small)
    joined = lookup_join(joined if small else written(joined, "own"), root, "piece", "left")
    joined = joined.select("state", "piece", *[c for c in joined.columns if c not in ("state", "piece")])
    blocked = F.coalesce(taken["blocked"], F.lit(False))
    if end_piece is not None:
        blocked = blocked & (F.col("piece") != end_piece)
    return joined.withColumn("blocked", blocked).withColumn("next_state", taken["next_state"]).drop("_own", "_root")


def blocked_alone(vocabulary: DataFrame, lex: T.Lexicon | None = None, patterns=P.PII) -> DataFrame:
    """(piece, by_term, by_pattern): pieces that hold a whole violation."""
    pieces = vocabulary.select("piece").distinct()
    by_pattern = P.has_match(F.col("piece"), patterns) if patterns else F.lit(False)
    if lex is None:
        by_term = pieces.withColumn("by_term", F.lit(False))
    else:
        by_term = T.flagged(pieces, lex, "by_term", text="piece")
    return by_term.withColumn("by_pattern", by_pattern).filter("by_term OR by_pattern")


def base_pieces(merges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Vocabulary pieces that are no merge result (``merges``: prefix, suffix)."""
    merged = merges.select(F.concat("prefix", "suffix").alias("piece"))
    return vocabulary.select("piece").distinct().join(merged, "piece", "left_anti")


def base_piece_check(merges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row of data-quality counts: do base and merged pieces add up to the vocabulary, and is
    every unmerged part of a merge a base piece?"""
    pieces = vocabulary.select("piece").distinct().withColumn("in_vocab", F.lit(1))
    merged = merges.select(F.concat("prefix", "suffix").alias("piece")).distinct().withColumn("is_merged", F.lit(1))
    parts = merges.select(F.explode(F.array("prefix", "suffix")).alias("piece")).distinct()
    parts = parts.withColumn("is_part", F.lit(1))
    flags = pieces.join(merged, "piece", "full").join(parts, "piece", "full").select(
        (F.coalesce("in_vocab", F.lit(0)) == 1).alias("v"),
        (F.coalesce("is_merged", F.lit(0)) == 1).alias("m"),
        (F.coalesce("is_part", F.lit(0)) == 1).alias("p"),
    )
    counts = flags.agg(
        F.count_if("v").alias("n_vocab"),
        F.count_if(F.col("v") & ~F.col("m")).alias("n_base"),
        F.count_if("m").alias("n_merged"),
        F.count_if(F.col("p") & ~F.col("m") & ~F.col("v")).alias("n_missing_parts"),
    )
    return counts.withColumn("adds_up", F.col("n_base") + F.col("n_merged") == F.col("n_vocab"))


def space_marker(vocabulary: DataFrame) -> DataFrame:
    """One row (marker, n): the most frequent first character among the known markers of pieces that
    continue with one of the marker words; a plain space when none occurs."""
    first = F.left("piece", F.lit(1))
    rest = F.substring("piece", 2, 1 << 30)
    seen = (
        vocabulary.filter(first.isin(*SPACE_MARKERS) & rest.isin(*MARKER_WORDS))
        .groupBy(first.alias("marker"))
        .agg(F.count("*").alias("n"))
    )
    best = seen.agg(F.max(F.struct("n", "marker")).alias("b"))
    return best.select(
        F.coalesce("b.marker", F.lit(" ")).alias("marker"), F.coalesce("b.n", F.lit(0)).alias("n")
    )
