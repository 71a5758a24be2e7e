"""Operators with a key that holds most rows: no partition far above the others, also without adaptive execution and broadcasts by size."""

import pytest
from pyspark.sql import functions as F

from fenceline import session
from fenceline.operators import candidates as C
from fenceline.operators import terms as T


@pytest.fixture
def shuffled(spark, monkeypatch):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(session, "BROADCAST_MAX_ROWS", 100)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def evenness(df):
    """Rows of the largest partition over the mean of those that have rows."""
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(sizes) / (sum(sizes) / len(sizes))


def hot_step(spark):
    n = F.col("id")
    return spark.range(0, 40_000, 1, 8).select(
        F.when(n < 39_000, "hot").otherwise(F.concat(F.lit("s"), n % 400)).alias("seq_id"),
        F.lit(0).alias("step"),
        F.concat(F.lit("c"), n).alias("cand"),
        ((n % 997) / 500).alias("logit"),
        F.lit(False).alias("is_eos"),
    )


def test_scores_of_a_hot_step(shuffled):
    scored = C.log_softmax(hot_step(shuffled))
    assert scored.count() == 40_000 and evenness(scored) <= 2
    total = scored.filter("seq_id = 'hot'").agg(F.sum(F.exp("logprob"))).first()[0]
    assert total == pytest.approx(1.0)


def test_choices_of_a_hot_step(shuffled):
    rows = hot_step(shuffled)
    few = C.top_k(rows, 20_000)
    assert few.filter("seq_id = 'hot'").count() >= 20_000 and evenness(few) <= 2
    most = C.top_p(rows, 0.9)
    kept = most.filter("seq_id = 'hot'")
    assert evenness(most) <= 2
    # The mass before the last candidate is at most p, that of all exceeds it.
    lowest = kept.agg(F.min("logit")).first()[0]
    mass = C.log_softmax(rows).filter("seq_id = 'hot'").select("cand", F.exp("logprob").alias("m"))
    held = kept.join(mass, "cand").agg(F.sum("m"), F.min("m")).first()
    assert held[0] > 0.9 and held[0] - held[1] <= 0.9 + 1e-9
    assert rows.filter(F.col("seq_id") == "hot").filter(F.col("logit") > lowest).count() <= kept.count()


def test_missing_and_repeated_texts(shuffled):
    spark = shuffled
    n = F.col("id")
    # Spread over the input, so that what is uneven comes from the operator.
    text = F.when(n % 20 < 12, None).when(n % 20 < 18, "the same bad text").otherwise(F.concat(F.lit("text "), n, F.when(n % 20 == 18, " worse").otherwise("")))
    docs = spark.range(0, 20_000, 1, 8).select(n.alias("doc_id"), text.alias("text"))
    lex = T.lexicon(spark.createDataFrame([("bad",), ("worse",)], "term STRING"), T.ENFORCE, 0)
    flagged = T.flagged(docs, lex, "held")
    assert evenness(flagged) <= 2
    assert {(r["held"], r["n"]) for r in flagged.groupBy("held").agg(F.count("*").alias("n")).collect()} == {(True, 7_000), (False, 13_000)}
    assert T.containing(docs, lex).count() == 7_000 and evenness(T.containing(docs, lex)) <= 2
    assert T.without(docs, lex).count() == 13_000 and evenness(T.without(docs, lex)) <= 2
