"""Redaction of spans from several sources: overlapping spans become one, texts are rebuilt from what is left.

Neither step has one task for a text: spans are ordered inside cells of a text and cells pass on one number each, and a text is
rebuilt block by block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..session import lookup_join, written
from . import spans as S
from . import terms as T

# Characters of a text whose spans are ordered together.
CELL = 4096


def _before(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def union(spans: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """(keys, start, end) of the union of the spans of each key, as far as it hangs together: spans that overlap are one, spans that only touch
    are not. Empty spans are dropped; repeated ones change nothing."""
    cells = [*keys, "_cell"]
    rows = spans.filter("start < end").select(*keys, "start", "end", F.floor(F.col("start") / cell).alias("_cell")).distinct()
    # How far the spans of earlier cells reach.
    tops = rows.groupBy(*cells).agg(F.max("end").alias("_top"))
    tops = tops.select(*cells, F.max("_top").over(_before(keys, "_cell")).alias("_reach"))
    inside = Window.partitionBy(*cells).orderBy("start", "end")
    earlier = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(tops, cells).withColumn("_reach", F.greatest("_reach", earlier))
    rows = rows.withColumn("_head", F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), F.col("start")))
    # A span that is no head belongs to the last head before it, perhaps in an earlier cell.
    heads = rows.groupBy(*cells).agg(F.max("_head").alias("_last"))
    heads = heads.select(*cells, F.max("_last").over(_before(keys, "_cell")).alias("_carried"))
    own = F.max("_head").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("_own", own).join(heads, cells).withColumn("_head", F.coalesce("_own", "_carried"))
    return placed.groupBy(*keys, "_head").agg(F.max("end").alias("end")).select(*keys, F.col("_head").alias("start"), "end")


def rebuilt(texts: DataFrame, spans: DataFrame, key: str, placeholder: str) -> DataFrame:
    """(key, redacted) of the texts (key, _text; distinct keys) with each of the ``spans`` (key, start, end), which do not overlap, replaced."""
    width = T.BLOCK_CHARS
    blocks = texts.select(key, F.explode(T._blocks(F.col("_text"), 0)).alias("_b")).select(
        key, F.floor(F.col("_b._at") / width).alias("_no"), F.col("_b._block").alias("_block")
    )
    parts = spans.select(key, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_no"))
    base = F.col("_no") * width
    # Spans inside a block, by its own offsets; the placeholder stands where a span begins.
    clipped = F.struct(
        F.greatest(F.col("start") - base, F.lit(0)).cast("int").alias("a"),
        F.least(F.col("end") - base, F.lit(width)).cast("int").alias("b"),
        F.when(F.col("start") >= base, F.lit(placeholder)).otherwise("").alias("sign"),
    )
    grouped = parts.groupBy(key, "_no").agg(F.array_sort(F.collect_list(clipped)).alias("_s"))
    last = F.struct(F.length("_block").alias("a"), F.length("_block").alias("b"), F.lit("").alias("sign"))
    from_ = lambda i: F.when(i > 0, F.get("_s", i - 1)["b"]).otherwise(0)
    cut = F.transform(
        F.array_append("_s", last),
        lambda x, i: F.concat(F.substr(F.col("_block"), from_(i) + 1, x["a"] - from_(i)), x["sign"]),
    )
    made = blocks.join(grouped, [key, "_no"], "left").withColumn("_t", F.when(F.col("_s").isNull(), F.col("_block")).otherwise(F.array_join(cut, "")))
    ordered = F.array_sort(F.collect_list(F.struct("_no", "_t")))
    return made.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["_t"]), "").alias("redacted"))


def redact_all(docs: DataFrame, lex: T.Lexicon, placeholder: str = "[X]", text: str = "text", patterns=P.PII, out: str = "redacted") -> DataFrame:
    """Add ``out``: the text with every match of a pattern and every occurrence of a term of a raw lexicon of any size replaced. What
    overlaps is replaced as one; a NULL text stays NULL. Keys of the caller play no part."""
    hashed = docs.withColumn("_hash", T.text_hash(text))
    texts = hashed.filter(F.col(text).isNotNull()).select("_hash", F.col(text).alias("_text"))
    by_pattern = S.spans(texts, "_hash", "_text", patterns).select("_hash", "start", "end")
    found = T.occurrences(texts, lex, ["_hash"], "_text")
    by_term = found.select("_hash", "start", (F.col("start") + F.length("term")).alias("end"))
    whole = written(union(by_pattern.unionByName(by_term), ["_hash"]), "spans")
    touched = lookup_join(texts, whole.select("_hash").distinct(), "_hash", "left_semi").dropDuplicates(["_hash"])
    made = written(rebuilt(touched, whole, "_hash", placeholder).withColumnRenamed("redacted", "_redacted"), "redacted")
    joined = lookup_join(hashed, made, "_hash", "left")
    return joined.withColumn(out, F.coalesce("_redacted", F.col(text))).drop("_hash", "_redacted")
