"""Sinks that keep what they are not given, numbering in any order, and counters."""

import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from fenceline import session
from fenceline.operators import running, runs
from fenceline.plans import preparation
from fenceline.sources import readers, writers


def lines_of(path):
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


def test_lines_lexicon(spark, tmp_path, request):
    # So small a table would be one part.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    terms = [f"t{i}" for i in range(5000)] + ['a"b', "c\\d", "é\n", ",", "]", "[", "😀", "t1", " x,"]
    random.Random(1).shuffle(terms)
    table = spark.createDataFrame([(t,) for t in terms], "term STRING").repartition(7)
    path = str(tmp_path / "lexicon")
    writers.write_json_lines_lexicon(table, path)
    text = lines_of(path)
    assert json.loads(text) == sorted(terms, key=lambda t: t.encode())
    assert "é" in text and "😀" in text
    # Many parts, none of which holds everything.
    assert len([p for p in Path(path).glob("part-*") if p.stat().st_size]) > 2
    assert sorted(r[0] for r in readers.read_json_lines_lexicon(spark, path).collect()) == sorted(terms)
    for few in ([], ["one"]):
        writers.write_json_lines_lexicon(spark.createDataFrame([(t,) for t in few], "term STRING"), path)
        assert json.loads(lines_of(path)) == few


def test_large_lexicon(spark, tmp_path):
    path = str(tmp_path / "large")
    writers.write_json_lines_lexicon(spark.range(300_000).select(F.concat(F.lit("w"), "id").alias("term")), path)
    assert readers.read_json_lines_lexicon(spark, path).distinct().count() == 300_000


def result(rows, spark):
    return spark.createDataFrame(rows, "method STRING, dataset STRING, model_alias STRING, batch_size STRING, seed STRING, idx BIGINT, output STRING")


def test_one_run_is_written_again(spark, tmp_path):
    path = str(tmp_path / "results")
    runs_ = [("ours", "RTP", "m", "1", s) for s in ("42", "43", "44")]
    writers.write_results(result([(*r, i, "old") for r in runs_ for i in range(4)], spark), path)
    writers.rewrite_runs(result([(*runs_[1], 9, "new"), ("base", "RTP", "m", "1", "42", 1, "more")], spark), path)
    found = readers.read_results(spark, path, "idx BIGINT, output STRING")
    got = sorted((r["method"], r["seed"], r["idx"], r["output"]) for r in found.collect())
    assert got == sorted([("ours", s, i, "old") for s in ("42", "44") for i in range(4)] + [("ours", "43", 9, "new"), ("base", "42", 1, "more")])
    plan = found.filter("seed = '43'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(seed" in plan


def test_numbered(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, 1.5, 2.5, float("nan")])) for _ in range(2000)] + [("hot", 1.0)] * 3000
    table = spark.createDataFrame(rows, "k STRING, v DOUBLE").repartition(5)
    got = running.numbered(table, ["k", "v"]).collect()
    assert sorted(r["idx"] for r in got) == list(range(len(rows)))
    place = {}
    for r in got:
        place.setdefault((r["k"] is not None, r["k"] or "", r["v"] is not None, str(r["v"]) if r["v"] != r["v"] else "", r["v"] if r["v"] == r["v"] and r["v"] is not None else 0), []).append(r["idx"])
    ranges = [place[k] for k in sorted(place)]
    assert [i for r in ranges for i in sorted(r)] == list(range(len(rows)))
    assert running.numbered(table.limit(0), ["k"]).count() == 0
    batches = running.batches_by(table, ["k"], 16)
    assert {r["batch_id"] for r in batches.collect()} == set(range(-(-len(rows) // 16)))


def test_equal_rows_are_no_single_range(spark, monkeypatch):
    made = []
    monkeypatch.setattr(running, "written", lambda df, name: made.append(session.written(df, name)) or made[-1])
    table = spark.range(0, 40_000, 1, 8).select(F.lit("same").alias("k"))
    assert running.numbered(table, ["k"]).agg(F.max("idx")).first()[0] == 39_999
    sizes = [r["n"] for r in made[-1].groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes) and len(sizes) > 2


def test_counts_of_one_pass(spark):
    text = "please write a letter to bob@example.org about it"
    docs = spark.createDataFrame([(i, text if i % 3 else "nothing") for i in range(60)], "doc_id BIGINT, text STRING")
    table, counts = preparation.counted_span_lexicon(docs, n=5)
    assert {r["stage"]: r["n"] for r in counts.collect()} == {"eligible": 40, "sampled": 5, "spans": 1}
    assert [r[0] for r in table.collect()] == ["bob@example.org"]
    for none in (docs.filter("text = 'nothing'"), docs.limit(0)):
        assert {r["n"] for r in preparation.counted_span_lexicon(none)[1].collect()} == {0}


def test_rollup(spark):
    rows = [("ours", "A", "m", "rtp_toxic_vocab", 10, 1), ("base", "A", "m", "rtp_toxic_vocab", 10, 5), ("ours", "B", None, "rtp_toxic_vocab", 0, 0), ("x", "C", "m", "unsupported", 9, 9)]
    report = spark.createDataFrame(rows, "method STRING, dataset STRING, model_alias STRING, mode STRING, total_examples BIGINT, violations BIGINT")
    got = {(r["level"], r["dataset"], r["model_alias"], r["method"]): (r["n_files"], r["violation_rate"]) for r in runs.run_rollup(report).collect()}
    assert got == {
        (3, None, None, None): (3, 30.0), (2, "A", None, None): (2, 30.0), (2, "B", None, None): (1, None), (1, "A", "m", None): (2, 30.0),
        (1, "B", None, None): (1, None), (0, "A", "m", "ours"): (1, 10.0), (0, "A", "m", "base"): (1, 50.0), (0, "B", None, "ours"): (1, None),
    }


def test_listing_sees_empty_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a b+c.jsonl").write_text("x\n")
    (tmp_path / "d" / "empty.jsonl").write_text("")
    (tmp_path / "other.txt").write_text("x")
    for pattern, want in (("*.jsonl", {("a b+c.jsonl", 2)}), ("*/*.jsonl", {("empty.jsonl", 0)})):
        assert {(r["file"].rsplit("/", 1)[1], r["length"]) for r in readers.list_files(spark, str(tmp_path), pattern).collect()} == want
