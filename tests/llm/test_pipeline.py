"""The pipeline, stage by stage, on awkward rows and on the given documents."""

from collections import Counter

import corpus_pipeline
import pytest
from llm_tables import SF
from test_corpus_operators import plain_clusters, plain_spans
from test_text_operators import check_packed

from fenceline.llm import mixing, quality, simhash
from fenceline.llm.common import table


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "suffix-array dedup", "mixing sources to target weights", "best-fit packing"
    ]


@pytest.mark.parametrize("which", ["docs", "given", "empty"])
def test_stages(spark, docs, empty, which):
    now = {"docs": docs, "empty": empty}.get(which) or table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, now, SF).cache()
    assert good.columns == now.columns
    scores = quality.scored(now, quality.trained(now, table(spark, SF, "labels")))
    assert good.count() == scores.where("score >= 0.3").count()

    now = now if which == "docs" else good
    one = stages["SimHash near-dedup"](spark, now, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in now.collect()]
    _, roots, least = plain_clusters(rows)
    assert one.columns == now.columns
    assert Counter(r["doc_id"] for r in one.collect()) == Counter(dict(zip(roots, least, strict=True)).values())

    left = stages["suffix-array dedup"](spark, one, SF).cache()
    rows = {r["doc_id"]: r["text"] for r in one.collect()}
    want = dict(zip(rows, plain_spans([(t or "").encode() for t in rows.values()], 200), strict=True))
    assert left.columns == one.columns and left.count() == one.count()
    for r in left.collect():
        size = len((r["text"] or "").encode())
        assert size <= want[r["doc_id"]][0] - want[r["doc_id"]][1] and (want[r["doc_id"]][1] or r["text"] == rows[r["doc_id"]])
        assert r["text"] is None or r["n_chars"] == len(r["text"]) or not want[r["doc_id"]][1]

    mixed = stages["mixing sources to target weights"](spark, left, SF).cache()
    counts = mixing.counted(left, mixing.rates(left)).select("row.doc_id", "count").collect()
    assert mixed.columns == left.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["count"] for r in counts if r["count"]})

    packed = stages["best-fit packing"](spark, mixed, SF).collect()
    check_packed([(r["doc_id"], r["text"]) for r in mixed.collect()], packed, 1024)


def test_near_copies_broadcast_no_probe_keys(spark, docs, monkeypatch):
    made, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **b: made.append(links(*a, **b)) or made[-1])
    corpus_pipeline.near_copies(spark, docs, SF)
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
