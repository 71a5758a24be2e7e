"""Small helpers around the session: shared scratch folder, splits, bounded broadcasts."""

from __future__ import annotations

import json
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side that may be broadcast, checked by an aggregate before the hint is given.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="fenceline-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Folders below the shared one that are made inside the block are removed at its end. What is to outlast it is written elsewhere, or
    collected, before. Blocks may be nested; without one the folders stay, as lazy results may still read them."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# What shuffles have written goes when their query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """Queries that are begun and ended inside leave no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, however often it is read, and safe
    from the loss of an executor. Its shuffles leave no files."""
    path = shared_folder(df.sparkSession, purpose)
    with cleaned(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame, *columns: str) -> DataFrame:
    """Keep the optimizer from copying the expressions behind ``columns`` into later filters, or
    from moving such filters below this point. The condition is always true and, naming the
    partition, counts as non-deterministic."""
    always = F.spark_partition_id() >= 0
    return df.select(*[F.when(always, F.col(c)).alias(c) if c in columns else c for c in df.columns])


def spread(df: DataFrame, key: str, *heavy: str) -> DataFrame:
    """Redistribute an input that has fewer splits than the cluster has cores.

    Text scanning is CPU-bound, so a handful of input splits would leave cores idle; tests on the
    ``heavy`` columns then run behind the exchange. Large inputs already have more splits than cores
    and pass through without a shuffle, their filters in the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return held(df.repartition(cores, key), *heavy)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether ``df`` is small enough to be sent to every executor."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    # Partial sums: no rows meet in one task.
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return row["n"] <= BROADCAST_MAX_ROWS and row["b"] <= BROADCAST_MAX_BYTES


def text_rows(spark: SparkSession, values, column: str) -> DataFrame:
    """A few driver-side strings as a table that is part of the plan."""
    return spark.range(1).select(F.explode(literal_array(values)).alias(column))


def literal_array(values, type_: str = "array<string>") -> Column:
    """Driver-side values as one constant, however many they are."""
    return F.from_json(F.lit(json.dumps(list(values))), type_)


def hot_keys(facts: DataFrame, on: list[str]) -> DataFrame | None:
    """The keys that hold more than one in 2n rows of ``facts``, n being the number of shuffle partitions; None
    without any. There are fewer than 2n of them, whatever the size of ``facts``. Rows are counted by partial sums."""
    spark = facts.sparkSession
    most = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = facts.select(*on).dropna().select(F.struct(*on).alias("_k")).rollup("_k").agg(F.count("*").alias("_n"))
    # The row of the total, which no key exceeds, and the largest keys.
    top = counts.orderBy(F.desc("_n"), F.col("_k").isNotNull()).limit(most + 1).collect()
    hot = [tuple(r["_k"]) for r in top[1:] if r["_n"] * most > top[0]["_n"] and r["_n"] > 1]
    return F.broadcast(spark.createDataFrame(hot, facts.select(*on).schema)) if hot else None


def often_keys(lookup: DataFrame, on: list[str], often: str) -> DataFrame | None:
    """As :func:`hot_keys`, by what a lookup of one row a key says of them."""
    spark = lookup.sparkSession
    most = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = lookup.agg(F.sum(often)).first()[0] or 0
    many = lookup.filter((F.col(often) * most > total) & (F.col(often) > 1)).select(*on).dropna().distinct()
    hot = [tuple(r) for r in many.limit(most).collect()]
    return F.broadcast(spark.createDataFrame(hot, lookup.select(*on).schema)) if hot else None


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: str | list[str], how: str = "inner", small: bool = False, often: str | None = None
) -> DataFrame:
    """Equi-join of a large, possibly skewed side with a lexicon-like side.

    A lookup within the broadcast bound is broadcast (``small`` says that its size is known). Beyond it the keys of ``facts`` are counted:
    rows of hot keys, see :func:`hot_keys`, meet their few lookup rows by broadcast, all others are joined by a plain shuffle. A NULL
    key matches nothing and is never shuffled. ``often``, a column of the lookup that is not joined, says how often a key occurs: nothing is counted then.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    keys = [on] if isinstance(on, str) else list(on)
    plain = lookup.drop(often) if often else lookup
    if small or fits_broadcast(plain):
        return facts.join(F.broadcast(plain), keys, how)
    if facts.isStreaming:
        # The keys of a stream can't be counted beforehand.
        return facts.join(plain, keys, how)
    known = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    joined = _split_join(facts.filter(known), plain, keys, how, often_keys(lookup, keys, often) if often else hot_keys(facts, keys))
    if how in ("inner", "left_semi"):
        return joined
    return joined.unionByName(facts.filter(f"NOT ({known})"), allowMissingColumns=True)


def _split_join(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str, hot: DataFrame | None) -> DataFrame:
    if hot is None:
        return facts.join(lookup, keys, how)
    few = lookup.join(hot, keys, "left_semi")
    if not fits_broadcast(few):
        # Many lookup rows to a key, no lookup proper: adaptive execution may still split the join.
        return facts.join(lookup, keys, how)
    rest = facts.join(hot, keys, "left_anti").join(lookup, keys, how)
    return rest.unionByName(facts.join(hot, keys, "left_semi").join(F.broadcast(few), keys, how))
