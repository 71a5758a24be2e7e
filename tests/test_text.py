"""Literal cases of scalar functions, fields and file names."""

from pyspark.sql import functions as F

from fenceline.functions import fields, text
from fenceline.operators import runs, sequences
from fenceline.operators import lexicon as L


def values(df):
    return [r[0] for r in df.collect()]


def test_strip_prompt(spark):
    cases = [
        ("Hi there", "Hi there friend", " friend"),
        ("Hi ", "</s></s> Hi friend", " friend"),
        ("Hi", "<|end_of_text|>Yo", "Yo"),
        ("Hi", "  Yo", "  Yo"),
        ("", "x", "x"),
        ("x", "", ""),
        ("   ", "  y", "y"),
        ("Hi ", "</s> Hi you", " you"),
        ("Hi", "\x1c</s>\x1dHi you", " you"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i INT, p STRING, a STRING, want STRING")
    got = df.select("p", "a", "want", text.strip_prompt(F.col("p"), F.col("a")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_strip_matches_python(spark):
    cases = ["  a b ", "　x ", "\x1f y\x1c", "", " \t\n", "a\n", "​z", "\x85q\x85"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i INT, s STRING").orderBy("i")
    assert values(df.select(text.strip(F.col("s")))) == [c.strip() for c in cases]
    assert values(df.select(text.rstrip(F.col("s")))) == [c.rstrip() for c in cases]
    assert values(df.select(text.lstrip(F.col("s")))) == [c.lstrip() for c in cases]


def test_norm_and_white_space(spark):
    df = spark.createDataFrame([(" Llama-3.1_8B ",)], "s STRING")
    assert values(df.select(text.norm(F.col("s")))) == ["llama_3_1_8b"]
    odd = "a" + "".join(text.WHITE_SPACE) + "b"
    df = spark.createDataFrame([(odd,)], "s STRING")
    assert values(df.select(text.canonical_space(F.col("s")))) == ["a" + " " * 11 + "b"]


def test_fields(spark):
    cases = [
        ('{"output":"x"}', "x"),
        ('{"output":{"text":"y"}}', "y"),
        ('{"output":{"text":5}}', ""),
        ('{"output":7}', ""),
        ('{"output":null}', ""),
        ("{}", ""),
        ('{"output":"","completion":"z"}', "z"),
        ('{"output":["x"],"answer":{"text":"w"}}', "w"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i INT, j STRING, want STRING")
    got = df.select(fields.answer_text(F.parse_json("j")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    df = spark.createDataFrame([('{"q":"a","prompt":"b"}',), ('{"q":"","query":"c"}',)], "j STRING")
    assert values(df.select(fields.prompt_text(F.parse_json("j"), "q"))) == ["a", "c"]


def test_file_names(spark):
    cases = [
        ("ours_RTP_Llama_3.1_8B_1_42.jsonl", ("ours", "RTP", "Llama_3.1_8B", "1", "42", None)),
        ("ours_RTP_phi_4_8_42.jsonl", ("ours", "RTP", "phi_4", "8", "42", None)),
        ("ours_a_b_Llama-3-1_8B_Instruct_8_42.jsonl", ("ours", "a_b", "Llama-3-1_8B_Instruct", "8", "42", None)),
        ("d/x.y/ours__gpt_j_6b_1_42.jsonl", ("ours", "", "gpt_j_6b", "1", "42", None)),
        ("a_b.jsonl", (None,) * 5 + ("Too few parts: a_b.jsonl",)),
        ("ours_RTP_phi_4_8_x.jsonl", (None,) * 5 + ("Seed not numeric: ours_RTP_phi_4_8_x.jsonl",)),
        ("ours_RTP_phi_4_y_42.jsonl", (None,) * 5 + ("Batch size not numeric: ours_RTP_phi_4_y_42.jsonl",)),
        ("ours_RTP_nomodel_1_42.jsonl", (None,) * 5 + ("Cannot parse model alias: ours_RTP_nomodel_1_42.jsonl",)),
        ("ours_RTP_x-gpt_j_6b_1_42.jsonl", (None,) * 5 + ("Cannot parse model alias: ours_RTP_x-gpt_j_6b_1_42.jsonl",)),
        ("ours_gpt_j_6b_1_42.jsonl", (None,) * 5 + ("Cannot parse dataset: ours_gpt_j_6b_1_42.jsonl",)),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "file STRING")
    got = {r["file"]: tuple(r)[1:] for r in runs.parse_names(df).collect()}
    for name, want in cases:
        assert got[name] == want, name


def test_mode_tests_the_whole_path(spark):
    df = spark.createDataFrame(
        [("enron/ours_RTP_phi_4_8_42.jsonl",), ("x/ours_RTP_phi_4_8_42.jsonl",), ("x/y.jsonl",)], "f STRING"
    )
    assert values(df.select(runs.mode(F.col("f")))) == ["enron_regex", "rtp_toxic_vocab", "unsupported"]


def test_output_name_is_parsed_back(spark):
    df = spark.createDataFrame([("RTP", "meta/Llama-3.1-8B-Instruct", 4, 42)], "d STRING, m STRING, b INT, s INT")
    named = df.select(runs.output_name(F.col("d"), F.col("m"), F.col("b"), F.col("s")).alias("file"))
    assert values(named) == ["ours_RTP_Llama_3.1_8B_4_42.jsonl"]
    assert runs.parse_names(named).first()["error"] is None


def test_rates(spark):
    files = spark.createDataFrame(
        [(f"ours_{d}_phi_4_1_42.jsonl",) for d in ("Enron", "RTP", "Other", "EnronX")] + [("bad.jsonl",)], "file STRING"
    )
    rows = [("ours_Enron_phi_4_1_42.jsonl", i, "p", t) for i, t in enumerate(["123-45-6789", "x", "y"])]
    rows += [("ours_RTP_phi_4_1_42.jsonl", 0, "p", "a bad day"), ("ours_RTP_phi_4_1_42.jsonl", 1, "p", "a BAD day")]
    rows += [("ours_Other_phi_4_1_42.jsonl", 0, "p", "a@b.co")]
    gens = spark.createDataFrame(rows, "file STRING, idx BIGINT, prompt STRING, output STRING")
    from fenceline.operators import terms as T

    for bound in (100, 0):
        lex = T.lexicon(spark.createDataFrame([(" Bad ",)], "term STRING"), T.EVAL, bound)
        got = {r["dataset"]: r for r in runs.violation_report(files, gens, lex).collect()}
        assert round(got["Enron"]["violation_rate"], 6) == 33.333333
        assert (got["RTP"]["violations"], got["RTP"]["violation_rate"]) == (1, 50.0)
        assert got["Other"]["total_examples"] == 1 and got["Other"]["violation_rate"] != got["Other"]["violation_rate"]
        assert got["EnronX"]["total_examples"] == 0 and got["EnronX"]["violation_rate"] != got["EnronX"]["violation_rate"]
    assert [tuple(r) for r in runs.rejects(files).collect()] == [("bad.jsonl", "Too few parts: bad.jsonl")]


def test_space_marker(spark):
    rows = [("Ġthe",)] * 3 + [("▁and",), (" the",), ("Ġcat",)]
    assert tuple(L.space_marker(spark.createDataFrame(rows, "piece STRING")).first()) == ("Ġ", 3)
    assert tuple(L.space_marker(spark.createDataFrame([("the",)], "piece STRING")).first()) == (" ", 0)


def test_until_end(spark):
    rows = [(1, 0, "a", False), (1, 1, "b", True), (1, 2, "c", True), (2, 0, "d", False)]
    df = spark.createDataFrame(rows, "seq_id BIGINT, pos BIGINT, piece STRING, is_eos BOOLEAN")
    got = {(r["seq_id"], r["pos"]) for r in sequences.until_end(df).collect()}
    assert got == {(1, 0), (1, 1), (2, 0)}
