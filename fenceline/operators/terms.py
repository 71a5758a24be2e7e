"""Texts against a lexicon of forbidden terms.

Three presets of one operator:

* ``ENFORCE`` - raw case-sensitive containment at any position,
* ``SELECT`` - both sides lowered, the term between two spaces,
* ``EVAL`` - the term stripped and lowered, the text as it is, the term between two spaces.

Whether a text holds any term of a lexicon of up to ``LITERAL_TERMS`` terms is one regular
expression, evaluated row by row without a shuffle. Larger lexicons, and the question which of
many terms a text holds, are joined by equality: on space-separated grams for the padded
presets, on character grams for raw containment.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Pattern
from ..functions.text import quote, strip
from ..session import fits_broadcast, literal_array, lookup_join, text_rows, written

ENFORCE, SELECT, EVAL = "ENFORCE", "SELECT", "EVAL"
LITERAL_TERMS = 4096
# Up to this many terms, which of them a text holds is tested term by term.
LISTED_TERMS = 64
# Characters that the beginnings of terms are told by, and up to how many beginnings are.
HEAD, HEADS = 3, 4096
# Up to this many terms, and characters of them, raw terms are found by one expression.
NAMED_TERMS, NAMED_CHARS = 16_384, 400_000
# Depth of the groups of one expression.
NESTED = 50
# Long texts are cut into blocks of this many characters before character grams are made.
BLOCK_CHARS = 4096
# Bits of the table that tells which keys a lookup may hold.
FILTER_BITS = 1 << 22


@dataclass(frozen=True)
class Lexicon:
    """Prepared distinct terms; ``literals`` holds them when there are few."""

    preset: str
    terms: DataFrame
    literals: tuple[str, ...] | None


def lexicon(terms: DataFrame, preset: str, literal_terms: int = LITERAL_TERMS) -> Lexicon:
    """Prepare ``terms.term`` for a preset. Empty terms, which would forbid every text, are dropped
    from ``ENFORCE`` and ``EVAL``."""
    term = F.col("term")
    prepared = terms.select(as_term(term, preset).alias("term"))
    if preset != SELECT:
        prepared = prepared.filter(term != "")
    prepared = prepared.filter(term.isNotNull()).distinct()
    first = sorted(r["term"] for r in prepared.limit(literal_terms + 1).collect())
    if len(first) <= literal_terms:
        return Lexicon(preset, text_rows(terms.sparkSession, first, "term"), tuple(first))
    # The terms are read for their lengths, for the size check and for the join.
    return Lexicon(preset, written(prepared, "lexicon"), None)


def as_term(term: Column, preset: str) -> Column:
    """A term in the form in which a preset compares it."""
    if preset == SELECT:
        return F.lower(term)
    if preset == EVAL:
        return F.lower(strip(term))
    if preset == ENFORCE:
        return term
    raise ValueError(f"unknown preset: {preset}")


def holds(text: Column, term: Column, preset: str) -> Column:
    """Whether a text holds a term under a preset."""
    prepared = as_term(term, preset)
    if preset == ENFORCE:
        return F.contains(text, prepared)
    return F.contains(F.lower(text) if preset == SELECT else text, F.concat(F.lit(" "), prepared, F.lit(" ")))


def _subject(lex: Lexicon, text: Column) -> Column:
    return F.lower(text) if lex.preset == SELECT else text


def _regex(lex: Lexicon) -> str:
    body = any_of(lex.literals)
    if lex.preset != ENFORCE:
        return f" {body} "
    starts = "".join(sorted({quote(t[0]) for t in lex.literals}))
    return f"(?=[{starts}]){body}"


def any_of(words) -> str:
    """An expression that matches each of the words, common beginnings shared, so that a position
    is tested against the possible first characters and not against every word. Groups are nested
    ``NESTED`` deep at most; what is left of the words there is listed."""
    out: list[str] = []
    # Open work: text to write, or words (sorted, different) with the length of their common beginning
    # that is written already and the depth.
    work: list = [(sorted({w for w in words if w}), 0, 0)]
    while work:
        item = work.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        group, done, depth = item
        if not group:
            continue
        shared = len(os.path.commonprefix([group[0], group[-1]]))
        out.append(quote(group[0][done:shared]))
        rest = [w for w in group if len(w) > shared]
        optional = len(rest) < len(group)
        if not rest:
            continue
        if depth == NESTED:
            listed = "|".join(quote(w[shared:]) for w in reversed(rest))
            out.append(f"(?:{listed})" + "?" * optional)
            continue
        heads: dict[str, list[str]] = {}
        for w in rest:
            heads.setdefault(w[shared], []).append(w)
        out.append("(?:")
        work.append(")?" if optional else ")")
        # Beginnings of many words are tried first.
        for i, branch in enumerate(sorted(heads.values(), key=len)):
            if i:
                work.append("|")
            work.append((branch, shared, depth + 1))
    return "".join(out)


def any_literal(lex: Lexicon, text: Column) -> Column:
    """Whether a text holds a term, for a lexicon within the literal bound."""
    if not lex.literals:
        return F.lit(False)
    if lex.preset == ENFORCE and len(lex.literals) <= LISTED_TERMS:
        table = literal_array(lex.literals)
        # The outer array evaluates a derived text once and not once per term.
        held = F.exists(F.array(text), lambda x: F.exists(table, lambda t: F.contains(x, t)))
        return F.coalesce(held, F.lit(False))
    return F.coalesce(_subject(lex, text).rlike(_regex(lex)), F.lit(False))


def text_hash(text: str) -> Column:
    """What identifies a text in joins: whether it holds a term depends on nothing else. Keys of the
    caller may be NULL or repeated."""
    return F.sha2(F.col(text), 256)


def _holding(docs: DataFrame, lex: Lexicon, text: str) -> DataFrame:
    """``_hash`` of the different texts that hold a term, as a table: it is counted before it is joined."""
    texts = docs.filter(F.col(text).isNotNull()).select(text_hash(text).alias("_hash"), F.col(text).alias("_text"))
    return written(hits(texts, lex, "_hash", "_text").select("_hash").distinct(), "holding")


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_hash", text_hash(text))


def flagged(docs: DataFrame, lex: Lexicon, out: str, text: str = "text") -> DataFrame:
    """Add ``out``: whether the text holds a term; a NULL text does not."""
    if lex.literals is not None:
        return docs.withColumn(out, any_literal(lex, F.col(text)))
    found = _holding(docs, lex, text).withColumn("_found", F.lit(True))
    joined = lookup_join(_hashed(docs, text), found, "_hash", "left")
    return joined.withColumn(out, F.coalesce("_found", F.lit(False))).drop("_found", "_hash")


def containing(docs: DataFrame, lex: Lexicon, text: str = "text") -> DataFrame:
    """Rows whose text contains a term."""
    if lex.literals is not None:
        return docs.filter(any_literal(lex, F.col(text)))
    return lookup_join(_hashed(docs, text), _holding(docs, lex, text), "_hash", "left_semi").drop("_hash")


def without(docs: DataFrame, lex: Lexicon, text: str = "text") -> DataFrame:
    """Rows whose text contains no term, NULL texts included."""
    if lex.literals is not None:
        return docs.filter(~any_literal(lex, F.col(text)))
    return lookup_join(_hashed(docs, text), _holding(docs, lex, text), "_hash", "left_anti").drop("_hash")


def hits(docs: DataFrame, lex: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (key, term) pairs of contained terms: rows of one key count as one text of it."""
    if lex.literals is not None and len(lex.literals) <= LISTED_TERMS:
        docs = docs.filter(any_literal(lex, F.col(text)))
        return docs.select(key, F.explode(_listed(lex, F.col(text))).alias("term")).distinct()
    if lex.preset == ENFORCE:
        size = lex.terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
        if 0 < size["n"] <= NAMED_TERMS and size["chars"] <= NAMED_CHARS and (lex.literals is not None or fits_broadcast(lex.terms)):
            return _named_hits(docs, [r["term"] for r in lex.terms.collect()], key, _long_words(lex, F.col(text))).distinct()
        return _char_gram_hits(docs, lex, key, _long_words(lex, F.col(text)), positions=False).distinct()
    if lex.literals is not None:
        docs = docs.filter(any_literal(lex, F.col(text)))
    return _word_gram_hits(docs, lex, key, _subject(lex, F.col(text)))


def _named_hits(docs: DataFrame, terms: list[str], key: str, subject: Column) -> DataFrame:
    """(key, term) of raw containment by one scan. At each place it finds the longest term that begins there; the others that do are
    beginnings of that term, which are looked up."""
    known = set(terms)
    pairs = [{"_found": t, "term": t[:i]} for t in terms for i in range(1, len(t) + 1) if t[:i] in known]
    table = docs.sparkSession.range(1).select(F.explode(literal_array(pairs, "array<struct<_found: string, term: string>>")).alias("_p")).select("_p.*")
    starts = "".join(sorted({quote(t[0]) for t in terms}))
    longest = F.regexp_extract_all(subject, F.lit(f"(?s)(?=[{starts}])(?=({any_of(terms)}))."), F.lit(1))
    found = docs.select(key, F.explode(F.array_distinct(longest)).alias("_found"))
    return lookup_join(found, table, "_found", small=True).select(key, "term")


def _long_words(lex: Lexicon, text: Column) -> Column:
    """The different space-separated words of a text that are as long as the shortest term: where no term holds a space, a text holds what
    they hold."""
    row = lex.terms.agg(F.min(F.length("term")).alias("least"), F.bool_or(F.contains("term", F.lit(" "))).alias("spaced")).first()
    if row["spaced"] or (row["least"] or 0) < HEAD:
        return text
    words = F.regexp_extract_all(text, F.lit(f"(?<![^ ])([^ ]{{{row['least']},}})"), F.lit(1))
    return F.array_join(F.array_distinct(words), " ")


def _listed(lex: Lexicon, text: Column) -> Column:
    """The terms of a lexicon of few literals that a text holds, tested one by one."""
    pad = F.lit("" if lex.preset == ENFORCE else " ")
    table = literal_array(lex.literals)
    # The outer array evaluates a derived text once and not once per term.
    inside = F.transform(F.array(_subject(lex, text)), lambda x: F.filter(table, lambda t: F.contains(x, F.concat(pad, t, pad))))
    return F.flatten(inside)


def hits_by_preset(docs: DataFrame, lexicons: list[Lexicon], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (key, preset, term) for several lexicons. Those of few literals are tested in one pass over the texts; each larger one takes
    its own."""
    few = [lex for lex in lexicons if lex.literals is not None and len(lex.literals) <= LISTED_TERMS]
    parts = []
    if few:
        def tagged(lex: Lexicon) -> Column:
            return F.transform(_listed(lex, F.col(text)), lambda t: F.struct(F.lit(lex.preset).alias("preset"), t.alias("term")))

        found = docs.filter(F.col(text).isNotNull()).select(key, F.explode(F.concat(*[tagged(lex) for lex in few])).alias("_h"))
        parts.append(found.select(key, "_h.*").distinct())
    for lex in lexicons:
        if lex not in few:
            parts.append(hits(docs, lex, key, text).select(key, F.lit(lex.preset).alias("preset"), "term"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def occurrences(docs: DataFrame, lex: Lexicon, keys: list[str], text: str = "text") -> DataFrame:
    """Every (key, term, start) of raw containment, overlaps included; ``start`` is 0-based."""
    if lex.preset != ENFORCE:
        raise ValueError("occurrences need raw containment")
    return _char_gram_hits(docs, lex, keys, F.col(text), positions=True)


def term_counts(docs: DataFrame, lex: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    return hits(docs, lex, key, text).groupBy("term").agg(F.count("*").alias("n_docs"))


def _word_gram_hits(docs: DataFrame, lex: Lexicon, key: str, subject: Column) -> DataFrame:
    """A padded term is a run of whole tokens of the space-split text that is neither the first
    nor the last one."""
    sizes = lex.terms.agg(F.collect_set(F.size(F.split("term", " ", -1)))).first()[0]
    tokens = F.split(subject, " ", -1)
    inner = F.when(F.size(tokens) > 2, F.slice(tokens, F.lit(2), F.size(tokens) - 2))

    def grams(k: int) -> Column:
        if k == 1:
            return F.col("_t")
        starts = F.sequence(F.lit(1), F.size("_t") - (k - 1))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(F.col("_t"), i, F.lit(k)), " "))
        return F.when(F.size("_t") >= k, joined).otherwise(F.array().cast("array<string>"))

    table = docs.select(key, inner.alias("_t")).filter("_t IS NOT NULL")
    every = F.concat(*[grams(k) for k in sorted(sizes)])
    exploded = table.select(key, F.explode(F.array_distinct(every)).alias("term"))
    return lookup_join(exploded, lex.terms, "term", small=lex.literals is not None).select(key, "term")


def _blocks(subject: Column, overlap: int) -> Column:
    """(offset, block) pieces of a text, each with ``overlap`` characters of the next one."""
    dot = f".{{1,{BLOCK_CHARS}}}"
    heads = F.regexp_extract_all(subject, F.lit(f"(?s)({dot})"), F.lit(1))
    tails = F.regexp_extract_all(subject, F.lit(f"(?s){dot}(?=(.{{0,{overlap}}}))"), F.lit(1))
    cut = F.transform(
        F.arrays_zip(heads.alias("h"), tails.alias("t")),
        lambda x, i: F.struct((i * BLOCK_CHARS).alias("_at"), F.concat(x["h"], x["t"]).alias("_block")),
    )
    whole = F.array(F.struct(F.lit(0).alias("_at"), subject.alias("_block")))
    return F.when(F.length(subject) <= BLOCK_CHARS + overlap, whole).otherwise(cut)


def _char_gram_hits(docs: DataFrame, lex: Lexicon, key, subject: Column, positions: bool) -> DataFrame:
    """Terms of length 2^j .. 2^(j+1)-1 are anchored on their first 2^j characters, so an anchor
    covers more than half of its term and few terms share one."""
    keys = [key] if isinstance(key, str) else list(key)
    level = F.length(F.bin(F.length("term"))) - 1
    anchor = F.left(F.col("term"), F.call_function("shiftleft", F.lit(1), level))
    stats = lex.terms.agg(F.collect_set(level), F.max(F.length("term"))).first()
    levels, longest = sorted(stats[0]), stats[1]
    if not levels:
        return docs.select(*keys, F.lit("").alias("term"), F.lit(0).alias("start")).limit(0)

    # A look-ahead captures the window at every character: from the anchor's width up to the longest
    # term of the level. One pattern per level; the compiled one is kept from row to row. Only windows that begin
    # like a term are cut, if the beginnings are few; where their place matters, the text between them is cut as well.
    heads: dict[int, list[str]] = {}
    head = F.left(F.col("term"), F.least(F.lit(HEAD), F.call_function("shiftleft", F.lit(1), level)))
    found = lex.terms.select(level.alias("l"), head.alias("h")).distinct().limit(HEADS + 1).collect()
    if len(found) <= HEADS:
        for r in found:
            heads.setdefault(r["l"], []).append(r["h"])

    def window(j: int) -> str:
        known = any_of(heads[j]) if heads else ""
        given = min(HEAD, 1 << j) if heads else 0
        ahead = f"(?=({known}.{{{(1 << j) - given},{(2 << j) - 1 - given}}}))."
        # The rest behind the last window is a match as well, so that no place is tried twice.
        return f"(?s)(.*?)(?:{ahead}|\\z)" if positions and heads else f"(?s){ahead}"

    blocks = docs.select(*keys, F.explode(_blocks(subject, longest - 1)).alias("_b")).select(*keys, "_b.*")
    if positions and heads:
        # Patterns are constants: of short texts, compiling them anew for each row would be most of the work. So would cutting texts that hold no
        # beginning.
        def listed_at(j: int) -> Column:
            windows, gaps = (F.regexp_extract_all(F.col("_block"), F.lit(window(j)), F.lit(group)) for group in (2, 1))
            own = F.struct(F.lit(1 << j).alias("_width"), windows.alias("_w"), F.transform(gaps, F.length).alias("_g"))
            return F.when(F.col("_block").rlike(any_of(heads[j])), own)

        every = F.array_compact(F.array(*[listed_at(j) for j in levels]))
        listed = blocks.select(*keys, "_at", F.explode(every).alias("_l")).select(*keys, "_at", "_l.*").filter("_w[0] <> ''")
        # A window begins behind the gaps up to its own and one character for each window before it.
        fresh = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))
        step = lambda a, g: F.struct((a["n"] + g + 1).alias("n"), F.array_append(a["at"], a["n"] + g).alias("at"))
        places = F.aggregate("_g", fresh, step, lambda a: a["at"])
        cut = listed.select(*keys, "_at", "_width", F.explode(F.arrays_zip(places.alias("i"), F.col("_w").alias("w"))).alias("_p"))
        cut = cut.filter("_p.w <> ''").select(*keys, "_width", F.col("_p.w").alias("window"), (F.col("_at") + F.col("_p.i")).alias("start"))
    else:
        cut = _windows(blocks, keys, {1 << j: window(j) for j in levels}, positions)
    probes = cut.withColumn("anchor", F.left("window", F.col("_width"))).drop("_width")
    anchored = lex.terms.select(anchor.alias("anchor"), "term")
    small = lex.literals is not None or fits_broadcast(anchored)
    # A shuffled join is given only the windows that may begin a term.
    found = lookup_join(probes if small else maybe_in(probes, anchored, "anchor"), anchored, "anchor", small=small)
    found = found.filter(F.startswith("window", "term"))
    if not positions:
        return found.select(*keys, "term")
    # A match inside the overlap of two blocks is seen from both.
    return found.select(*keys, "term", "start").distinct()


def _windows(blocks: DataFrame, keys: list[str], patterns: dict[int, str], positions: bool) -> DataFrame:
    """The windows of blocks by one pattern to a width, each with its start or else once a block."""
    table = F.array(*[F.struct(F.lit(width).alias("_width"), F.lit(pattern).alias("_re")) for width, pattern in patterns.items()])
    leveled = blocks.select(*keys, "_at", "_block", F.explode(table).alias("_l")).select(*keys, "_at", "_block", "_l._width", "_l._re")
    windows = F.regexp_extract_all(F.col("_block"), F.col("_re"), F.lit(1))
    if positions:
        cut = leveled.select(*keys, "_at", "_width", F.posexplode(windows).alias("_i", "window"))
        return cut.withColumn("start", F.col("_at") + F.col("_i")).drop("_at", "_i")
    return leveled.select(*keys, "_width", F.explode(F.array_distinct(windows)).alias("window"))


def maybe_in(rows: DataFrame, lookup: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The ``rows`` whose key may occur in ``lookup``: all that do, and of the others as few as one bit per hash tells. The bits are a constant of
    fixed size, whatever the lookup's."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    own = lookup.select(place.alias("_p")).groupBy(F.floor(F.col("_p") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_p") % 64).cast("int"))).alias("b")
    )
    words = [0] * (bits // 64)
    for r in own.collect():  # FILTER_BITS / 64 rows at most
        words[r["w"]] = r["b"]
    word = F.get(literal_array(words, "array<bigint>"), F.floor(place / 64).cast("int"))
    return rows.filter(F.getbit(word, (place % 64).cast("int")) == 1)


def redundant_terms(terms: DataFrame, literal_terms: int = LITERAL_TERMS) -> DataFrame:
    """(term, contained): terms that contain another term and so can never complete first."""
    lex = lexicon(terms, ENFORCE, literal_terms)
    texts = lex.terms.select(F.col("term").alias("longer"), F.col("term").alias("text"))
    return (
        hits(texts, lex, key="longer")
        .filter(F.col("longer") != F.col("term"))
        .select(F.col("longer").alias("term"), F.col("term").alias("contained"))
    )


def minimal_terms(terms: DataFrame, literal_terms: int = LITERAL_TERMS) -> DataFrame:
    """Terms that contain no other term; forbidding them forbids the same texts."""
    lex = lexicon(terms, ENFORCE, literal_terms)
    redundant = redundant_terms(terms, literal_terms).select("term").distinct()
    return lex.terms.join(redundant, "term", "left_anti")


def term_pattern(lex: Lexicon, name: str = "terms") -> Pattern:
    """A small raw lexicon as one pattern. Without terms that contain another one, the leftmost
    match is also the first to complete."""
    if not lex.literals or lex.preset != ENFORCE:
        raise ValueError("needs a non-empty ENFORCE lexicon within the literal bound")
    minimal = [t for t in lex.literals if not any(u != t and u in t for u in lex.literals)]
    body = any_of(minimal)
    return Pattern(name, body, completing=body, reach=max(map(len, minimal)) - 1)
