"""Sources and sinks through files of a temporary directory."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fenceline.plans import evaluation
from fenceline.operators import runs
from fenceline.operators import terms as T
from fenceline.sources import readers, writers


def terms(df):
    return sorted(r["term"] for r in df.collect())


def test_lexicon_lines(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("bad\n\n# note\n  \n padded \nbad\n#x\n two words\n", encoding="utf-8")
    assert terms(readers.read_lexicon_lines(spark, str(path))) == ["bad", "bad", "padded", "two words"]


def test_json_lexicons(spark, tmp_path):
    a, b, c = (tmp_path / f"{n}.json" for n in "abc")
    a.write_text(json.dumps(["x", "ü", "x"], indent=2, ensure_ascii=False), encoding="utf-8")
    b.write_text(json.dumps(["x", " Y ", 7, None, {"z": 1}, ""]), encoding="utf-8")
    c.write_text(json.dumps({"x": 1}), encoding="utf-8")
    found, rejects = readers.read_json_lexicons(spark, [str(p) for p in (a, b, c, tmp_path / "none.json")])
    assert terms(found) == ["", " Y ", "x", "ü"]
    errors = {Path(r["file"]).name: r["error"] for r in rejects.collect()}
    assert errors == {"none.json": "File not found", "c.json": "Not an array"}
    assert terms(readers.read_evaluation_lexicon(spark, str(b))) == ["x", "y"]
    assert terms(readers.read_evaluation_lexicon(spark, str(c))) == []
    assert terms(readers.read_json_lexicons(spark, [str(tmp_path / "none.json")])[0]) == []


def test_json_lexicon_sink(spark, tmp_path):
    out = str(tmp_path / "lex")
    words = ["zü", 'a"b', "a\\b", "\t"]
    df = spark.createDataFrame(list(enumerate(words)), "ord INT, term STRING")
    writers.write_json_lexicon(df, out)
    written = next(Path(out).glob("part-*")).read_text(encoding="utf-8")
    assert json.loads(written) == sorted(words) and "zü" in written
    assert written.rstrip("\n") == json.dumps(sorted(words), ensure_ascii=False, indent=2)
    writers.write_json_lexicon(df, out, order="ord")
    assert json.loads(next(Path(out).glob("part-*")).read_text(encoding="utf-8")) == words
    found, _ = readers.read_json_lexicons(spark, [next(str(p) for p in Path(out).glob("part-*"))])
    assert terms(found) == sorted(words)
    writers.write_json_lexicon(df.limit(0), out)
    assert json.loads(next(Path(out).glob("part-*")).read_text(encoding="utf-8")) == []


def test_evaluation_round_trip(spark, tmp_path):
    root = tmp_path / "my +%20result"
    root.mkdir()
    (root / "ours_Enron_phi_4_1_42.jsonl").write_text(
        '{"idx": 0, "prompt": "Hi", "output": "Hi 123-45-6789"}\n\n  {"idx": 1, "input": "x", "answer": {"text": "ü"}} \n',
        encoding="utf-8",
    )
    (root / "ours_RTP_phi_4_1_42.jsonl").write_text("", encoding="utf-8")
    (root / "odd.jsonl").write_text('{"idx": 0}\n', encoding="utf-8")
    (root / "notes.txt").write_text("no json", encoding="utf-8")
    files = readers.list_files(spark, str(root))
    assert [Path(r["file"]).name for r in files.collect()] == [
        "odd.jsonl",
        "ours_Enron_phi_4_1_42.jsonl",
        "ours_RTP_phi_4_1_42.jsonl",
    ]
    gens = readers.read_generations(spark, str(root))
    assert {(r["idx"], r["prompt"], r["output"]) for r in gens.collect()} == {
        (0, "Hi", "Hi 123-45-6789"),
        (1, "x", "ü"),
        (0, "", ""),
    }
    lex = T.lexicon(spark.createDataFrame([("bad",)], "term STRING"), T.EVAL)
    report = runs.violation_report(files, gens, lex)
    path = writers.write_report(report, str(root))
    assert path == f"{root}_violation_results.csv"
    rows = spark.read.option("header", True).csv(path).orderBy("file").collect()
    assert [(r["dataset"], r["total_examples"], r["violations"], r["violation_rate"]) for r in rows] == [
        ("Enron", "2", "1", "50.0"),
        ("RTP", "0", "0", "NaN"),
    ]
    assert list(rows[0].asDict()) == [
        "file", "method", "dataset", "model_alias", "batch_size", "seed", "mode", "total_examples", "violations",
        "violation_rate",
    ]
    writers.write_rejects(runs.rejects(files), str(tmp_path / "rejects"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rejects")).count() == 1


def test_no_files_and_bad_lines(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.list_files(spark, str(tmp_path), "*.jsonl")
    (tmp_path / "a.jsonl").write_text("{not json}\n", encoding="utf-8")
    with pytest.raises(Exception):
        readers.read_records(spark, str(tmp_path)).collect()


def test_badly_named_files_are_not_read(spark, tmp_path):
    root = tmp_path / "runs"
    root.mkdir()
    (root / "ours_Enron_phi_4_1_42.jsonl").write_text('{"idx": 0, "output": "123-45-6789"}\n', encoding="utf-8")
    (root / "odd.jsonl").write_text("{not json\n", encoding="utf-8")
    (tmp_path / "lex.json").write_text('["bad"]', encoding="utf-8")
    report, rejects = evaluation.evaluate(spark, str(root), str(tmp_path / "lex.json"))
    assert [(r["total_examples"], r["violations"]) for r in report.collect()] == [(1, 1)]
    assert [r["file"] for r in rejects.collect()] == ["odd.jsonl"]
    (root / "ours_Enron_phi_4_1_42.jsonl").rename(root / "good.jsonl")
    report, rejects = evaluation.evaluate(spark, str(root), str(tmp_path / "lex.json"))
    assert report.count() == 0 and rejects.count() == 2


def test_generation_sink(spark, tmp_path):
    out = str(tmp_path / "gens")
    df = spark.createDataFrame([(0, "p ü", 'o "q"\n')], "idx BIGINT, prompt STRING, output STRING")
    writers.write_generations(df, out)
    raw = "".join(p.read_text(encoding="utf-8") for p in Path(out).glob("part-*.json"))
    assert json.loads(raw) == {"idx": 0, "prompt": "p ü", "output": 'o "q"\n'} and "ü" in raw
    back = readers.read_generations(spark, out, "*.json").drop("file").collect()
    assert [tuple(r) for r in back] == [(0, "p ü", 'o "q"\n')]


def test_partitioned_results_prune(spark, tmp_path):
    out = str(tmp_path / "runs")
    names = spark.createDataFrame(
        [("ours_RTP_phi_4_1_42.jsonl",), ("base_Enron_gpt_j_6b_8_42.jsonl",)], "file STRING"
    )
    writers.write_results(runs.parse_names(names), out)
    read = spark.read.parquet(out).filter(F.col("method") == "base")
    assert read.count() == 1 and len(read.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(method" in read._jdf.queryExecution().toString()


def test_span_sink_and_corpus(spark, tmp_path):
    out = str(tmp_path / "spans")
    writers.write_spans(spark.createDataFrame([("a@b.co",)], "span STRING"), out)
    assert readers.corpus(spark, out).first()["span"] == "a@b.co"
    assert readers.corpus(spark, out, "span STRING").columns == ["span"]
