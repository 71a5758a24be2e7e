"""Physical plans: no nested-loop joins, no Python outside the stateful scan, pruned scans."""

import pytest

import __spark_entry__ as entry
from fenceline.operators import running
from fenceline.operators import terms as T
from fenceline.plans import views as V

SF = "/root/testdata/sf0.001"
STREAMS = {"stream_filter", "stream_scan"}
# One row against a handful of runs.
ONE_ROW_JOINS = {"throughput"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - STREAMS))
def test_no_products_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text or name in ONE_ROW_JOINS
    for node in ("Python", "InPandas", "ArrowEval"):
        assert node not in text


def test_scans_are_pruned(spark):
    text = plan(entry.queries()["pii_by_pattern"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    text = plan(entry.queries()["seeded_sample"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint>" in text and "TakeOrderedAndProject" in text


def test_large_input_is_not_reshuffled(spark):
    from fenceline.session import spread

    many = spark.range(0, 1000, 1, 64)
    assert spread(many, "id") is many


def test_small_lexicon_needs_no_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lex = T.lexicon(V.lexicon8(spark), T.ENFORCE)
    assert "Exchange" not in plan(T.containing(docs, lex))


def test_gram_join_is_one_generated_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = T.hits(docs, T.lexicon(V.lexicon8(spark), T.ENFORCE, 0))
    df.collect()
    text = plan(df)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_batches_order_rows_inside_cells(spark):
    """The only unpartitioned window runs over the cell totals."""
    text = plan(running.batches(spark.range(0, 100_000, 1, 8).withColumnRenamed("id", "k"), "k", 64))
    windows = [line for line in text.splitlines() if "windowspecdefinition(" in line and "Window [" in line]
    assert any("_cell" in w and "k#" in w for w in windows)
    for w in windows:
        if "windowspecdefinition(_cell" not in w:
            assert "_t#" in w
