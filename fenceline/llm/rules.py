"""Quality rules as a ledger of bits: every rule is evaluated once, policies only read the bits.

``ledger`` measures each text, evaluates all rules and stores the failures of a row as one long
(bit i: rule i failed) beside the measurements. ``judged`` applies a version of the policy, a mask
of the bits that count. ``ablation`` counts, by bitwise aggregation over ledgers, what each rule
rejects alone and with others. Nothing here reads a text twice, and nothing is shuffled but the
few sums of the ablation.

Nulls and empty texts have no words and fail ``few_words``; their other measurements are 0.
Repeated rows are judged one by one; other columns of the input are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Name and failure condition over the measurements, in the order of the bits. A new rule is
# appended, so that the bits of stored ledgers keep their meaning.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

# Versions of the policy: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
}
MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _neighbours(column: str) -> tuple[Column, Column]:
    """An array without its last element, and without its first."""
    return F.slice(column, 1, F.size(column) - 1), F.slice(column, 2, F.size(column) - 1)


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (its ``doc_id``) and what the rules look at.

    A text's windows of eight words are compared by 64-bit hashes within that text. Positions of
    windows that occur again are sorted, and a window covers eight words or as many as there are
    up to the next one.
    """
    keep = ["doc_id"] if keep is None else keep
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    words = own.select(
        "row",
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", WHITE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    windows = words.select(
        "row",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") > WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice("words", i, WINDOW)),
            ),
        ).alias("windows"),
    )
    # Sorted hashes with their positions, for the texts in which a window occurs again.
    ordered = windows.withColumn(
        "windows",
        F.when(
            F.size("windows") > F.size(F.array_distinct("windows")),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    again = ordered.withColumn(
        "windows",
        F.zip_with(
            *_neighbours("windows"),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        ),
    ).withColumn("windows", F.sort_array(F.array_distinct(F.flatten("windows"))))
    covered = F.aggregate(
        F.zip_with(*_neighbours("windows"), lambda a, b: F.least(b - a, F.lit(WINDOW))),
        F.lit(WINDOW),
        lambda total, n: total + n,
    )
    return again.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("windows")


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The measurements of every row, and in ``failed`` the bits of the rules that it fails."""
    measures = measured(docs, text, keep)
    bits = [F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)) for name, condition in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measures.select("row.*", *MEASUREMENTS, "n_lines", failed.cast("long").alias("failed"))


def judged(ledger_: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a version of the policy."""
    bits = lambda version: F.col("failed").bitwiseAND(F.lit(mask(version))) != 0
    return ledger_.withColumns(
        {"base_failed": bits("base"), "kept": ~(bits("base") | bits(policy)), "policy": F.lit(policy)}
    )


def ablation(ledger_: DataFrame, policy: str = "v2") -> DataFrame:
    """One row per rule of a policy: rows that fail it, rows that only it rejects (they would be kept
    without it), the rules that ever fail with it as bits, and the rows that the policy keeps."""
    counted = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    sums = [F.count_if(counted == 0).alias("n_kept")]
    for name in POLICIES[policy]:
        has = counted.bitwiseAND(F.lit(BIT[name])) != 0
        sums.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.count_if(has).alias("n_failed"),
                F.count_if(counted == BIT[name]).alias("n_only"),
                F.coalesce(F.bit_or(F.when(has, counted)), F.lit(0)).alias("fails_with"),
            ).alias(f"rule_{name}")
        )
    one = ledger_.agg(*sums)
    rules = F.explode(F.array(*[F.col(f"rule_{name}") for name in POLICIES[policy]]))
    return one.select("n_kept", rules.alias("r")).select("r.*", "n_kept")
