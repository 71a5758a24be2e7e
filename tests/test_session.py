"""Joins with hot keys: same rows as a plain join, no large partition."""

import glob

import pytest
from pyspark.sql import functions as F

from fenceline import session


@pytest.fixture
def shuffled(spark, monkeypatch):
    """No broadcast by size, no adaptive splitting."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(session, "BROADCAST_MAX_ROWS", 100)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def largest(df):
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(sizes), sum(sizes) / len(sizes)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_equals_a_plain_join(shuffled, how):
    spark = shuffled
    key = F.when(F.col("id") < 900, 7).when(F.col("id") < 1200, None).otherwise(F.col("id") % 500)
    facts = spark.range(3000).select(key.alias("k"), F.lit("x").alias("k2"), (F.col("id") % 3).alias("v"))
    lookup = spark.range(0, 400, 1).select(F.col("id").alias("k"), F.lit("x").alias("k2"), (F.col("id") * 2).alias("w"))
    for on in ("k", ["k", "k2"]):
        own = lookup if on != "k" else lookup.drop("k2")
        got = session.lookup_join(facts, own, on, how)
        expected = facts.join(own, [on] if isinstance(on, str) else on, how).select(*got.columns)
        order = got.columns
        assert sorted(map(str, got.select(*order).collect())) == sorted(map(str, expected.collect()))


def test_hot_and_null_keys_are_split(shuffled):
    spark = shuffled
    key = F.when(F.col("id") < 16_000, 1).when(F.col("id") < 24_000, None).otherwise(F.col("id"))
    facts = spark.range(0, 40_000, 1, 8).select(key.alias("k"), F.lit(1).alias("v"))  # repeated rows, too
    lookup = spark.range(40_000).select(F.col("id").alias("k"), F.lit(2).alias("w"))
    most, mean = largest(session.lookup_join(facts, lookup, "k", "left"))
    assert most <= 2 * mean
    assert [r["k"] for r in session.hot_keys(facts, ["k"]).collect()] == [1]
    assert session.hot_keys(lookup, ["k"]) is None
    assert session.hot_keys(facts.limit(0), ["k"]) is None


def test_scratch_folders_are_removed(spark, tmp_path):
    import os

    with session.scratch(spark):
        path = session.shared_folder(spark, "mine")
        spark.range(3).write.parquet(path)
        with session.scratch(spark):
            inner = session.written(spark.range(2), "inner")
            assert inner.count() == 2
        with pytest.raises(Exception, match="not exist|FILE|No such"):
            inner.count()
        assert os.path.isdir(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))
    kept = session.written(spark.range(2), "kept")
    assert kept.count() == 2


def test_tables_between_steps_are_written_compactly(spark):
    table = session.written(spark.range(10), "compact")
    assert all(f.endswith(".zstd.parquet") for f in table.inputFiles())


def test_written_tables_leave_no_shuffle_files(spark):
    folders = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    left = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}
    before, kept = left(), spark.conf.get(session.CLEANUP, None)
    table = session.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    table = session.written(table.repartition(3, "k"), "dealt")
    assert not {f for f in left() - before if f.endswith(".data")} and spark.conf.get(session.CLEANUP, None) == kept
    assert table.count() == 7


def test_hot_keys_that_the_lookup_tells(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_MAX_ROWS", 10)
    monkeypatch.setattr(session, "hot_keys", lambda *_: 1 / 0)
    key = F.when(F.col("id") < 900, F.lit(0)).when(F.col("id") == 999, None).otherwise(F.col("id"))
    facts = spark.range(1000).select(key.alias("k"), "id")
    lookup = facts.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2).filter("k IS NULL OR k <> 950")
    joined = session.lookup_join(facts, lookup, "k", often="n")
    assert joined.columns == ["k", "id", "v"] and "Union" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in joined.collect()) == [(0 if i < 900 else i, i, 0 if i < 900 else 2 * i) for i in range(999) if i != 950]
