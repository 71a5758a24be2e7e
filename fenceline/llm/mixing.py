"""Mixing sources to target weights by Poisson replication.

``rates`` gives each source its mean repetition rate: its share of the target weights times the target
size, over its own size. ``mixed`` gives each document a count that is Poisson distributed with that mean,
by inverting the distribution at a uniform number hashed from seed and document, explodes the document by its count and
shuffles all copies globally, by a hash of seed, document and copy.

The draw depends on the seed and the document's id, source and text only: a lost task draws the same again.
Rows equal in these draw the same count. A null source is a source of its own, a null text has size 1
like an empty one. Sources without a positive weight get rate 0, so their rows go. A source far below its target has a high rate;
a rate of a million takes a table of 24,000 numbers, and a document's place in it is found by halving. An empty table gives an empty mix. Other columns
are carried along unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import lookup_join, written
from .common import packed

SEED = "mix-1"
# Sources are weighted by their size to this power: below 1 lifts small sources.
POWER = 0.5
# Hex digits of the hash that make the uniform number.
DIGITS = 13


def document_size(text: str = "text") -> Column:
    """Bytes of the text and one for its end."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1, hashed from the parts; a null part counts as the word null."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def thresholds(rates_: DataFrame) -> DataFrame:
    """(_source, _low, _steps): the distribution function of a Poisson variable with mean ``rate`` at _low, _low + 1, ... as an array.

    It covers twelve standard deviations and thirty on both sides of the mean, outside of which a double is 0 or 1; an array has about
    24 sqrt(rate) entries. Probabilities come from sums of the logarithms of their ratios, relative to the greatest one, so no rate underflows.
    """
    reach = F.ceil(12 * F.sqrt("rate") + 30)
    named = rates_.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_source"),
        F.when(F.col("rate") > 0, F.col("rate")).otherwise(0.0).alias("rate"),
    )
    bounds = named.withColumn("_low", F.greatest(F.floor(F.col("rate") - reach), F.lit(0)).cast("long"))
    each = bounds.where("rate > 0").select("_source", "rate", "_low", F.explode(F.sequence("_low", F.ceil(F.col("rate") + reach).cast("long"))).alias("_k"))
    whole = Window.partitionBy("_source")
    so_far = whole.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    ratio = F.when(F.col("_k") == F.col("_low"), 0.0).otherwise(F.ln("rate") - F.ln(F.col("_k").cast("double")))
    logs = each.withColumn("_log", F.sum(ratio).over(so_far))
    shares = logs.withColumn("_share", F.exp(F.col("_log") - F.max("_log").over(whole)))
    summed = shares.withColumn("_p", F.sum("_share").over(so_far) / F.sum("_share").over(whole))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_p"))), lambda x: x["_p"])
    some = summed.groupBy("_source").agg(F.first("_low").alias("_low"), steps.alias("_steps"))
    # Without a rate there are no copies.
    none = bounds.where("rate = 0").select("_source", "_low", F.array(F.lit(1.0)).alias("_steps"))
    return some.unionByName(none)


def reached(steps: Column, u: Column) -> Column:
    """How many of the ascending ``steps`` are at most ``u``, by halving."""
    bits = F.ceil(F.log2(F.size(steps) + F.lit(1))).cast("int")

    def halve(place: Column, bit: Column) -> Column:
        next_ = place + F.call_function("shiftleft", F.lit(1), bit)
        return F.when(F.get(steps, next_ - 1) <= u, next_).otherwise(place)

    return F.aggregate(F.reverse(F.sequence(F.lit(0), bits - 1)), F.lit(0), halve)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, total: float | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """One row per source: ``source``, ``size``, ``rate``.

    ``weights`` are the target weights; without them a source weighs its size to ``power``. ``total`` is
    the size of the mix, that of ``docs`` by default.
    """
    sizes = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(document_size(f"`{text}`")).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("_weight", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        # As many branches as the caller named sources.
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
        weighed = sizes.withColumn("_weight", weight)
    sums = weighed.agg(F.sum("_weight").alias("w"), F.sum("size").alias("s")).first()
    if not sums["w"]:
        return sizes.withColumn("rate", F.lit(0.0))
    size = F.lit(float(sums["s"] if total is None else total))
    rate = F.col("_weight") / F.lit(sums["w"]) * size / F.col("size")
    return weighed.select("source", "size", rate.alias("rate"))


def counted(docs: DataFrame, rates_: DataFrame, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``row`` (the document) and ``count`` (its Poisson count)."""
    steps = written(thresholds(rates_), "steps")
    own = packed(docs)
    own = own.select(
        "row",
        F.coalesce(F.concat(F.lit("s"), F.col(f"row.`{source}`")), F.lit("n")).alias("_source"),
        uniform(F.lit(seed), F.col(f"row.`{key}`"), F.col(f"row.`{source}`"), F.md5(F.coalesce(F.col(f"row.`{text}`"), F.lit("")))).alias("_u"),
    )
    drawn = lookup_join(own, steps, "_source")
    return drawn.select("row", (F.col("_low") + reached(F.col("_steps"), F.col("_u"))).cast("int").alias("count"))


def mixed(docs: DataFrame, rates_: DataFrame, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text", shuffled: bool = True) -> DataFrame:
    """The copies: ``row``, ``count``, ``copy`` (from 0) and ``order_key``, in whose order they are written.

    ``shuffled=False`` leaves the order to the caller, who has the key.
    """
    counts = counted(docs, rates_, seed, key, source, text).where("count > 0")
    copies = counts.select("row", "count", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("copy"))
    order = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in (F.col(f"row.`{key}`"), F.col(f"row.`{source}`"), F.col("copy"))]))
    keyed = copies.withColumn("order_key", order)
    return keyed.repartitionByRange("order_key").sortWithinPartitions("order_key") if shuffled else keyed
