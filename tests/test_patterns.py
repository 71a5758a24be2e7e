"""Forbidden patterns against Python's regular expressions on random strings."""

import random
import re
import time

from pyspark.sql import functions as F

from fenceline.functions import patterns as P
from fenceline.operators import spans
from fenceline.plans import preparation

ALL = re.compile(P.alternation())


def random_texts(n=6000, seed=1):
    rng = random.Random(seed)
    bits = ["a", "b@", "@", ".", "co", ".co", "-", "1", "12", "123-", "45-", "6789", "4567-", " ", "\n", "é", "😀", "_%+", "x@y.zz"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(8)


def shortest_completion(text, regexes):
    compiled = [re.compile(r) for r in regexes]
    for n in range(1, len(text) + 1):
        if any(c.search(text[:n]) for c in compiled):
            return n
    return None


def test_matches_offsets_and_completion(spark):
    texts = random_texts()
    body = F.col("text")
    rows = (
        table(spark, texts)
        .select(
            "doc_id",
            P.has_match(body).alias("has"),
            P.leftmost(body).alias("left"),
            P.prompt_cut(body).alias("cut"),
            P.first_reason(body).alias("reason"),
            P.first_completion(body).alias("end"),
            P.clean_prefix(body).alias("prefix"),
            P.redact(body).alias("redacted"),
            *[P.completion_end(body, p).alias(p.name) for p in P.PII],
        )
        .collect()
    )
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        m = ALL.search(t)
        assert bool(r["has"]) == bool(m)
        assert r["left"] == (m.group(0) if m else None)
        assert r["cut"] == (t[: m.start()] if m else None)
        reason = next((f"match:{p.regex}" for p in P.PII if re.search(p.regex, t)), "ok")
        assert r["reason"] == reason
        assert r["end"] == shortest_completion(t, [p.regex for p in P.PII]), t
        for p in P.PII:
            assert r[p.name] == shortest_completion(t, [p.regex]), t
        assert r["prefix"] == (t if r["end"] is None else t[: r["end"] - 1])
        assert not ALL.search(r["prefix"])
        assert r["redacted"] == ALL.sub("[PII]", t)
        assert not ALL.search(r["redacted"])


def test_spans(spark):
    texts = random_texts(3000, 2)
    got = {}
    for r in spans.spans(table(spark, texts)).collect():
        got.setdefault(r["doc_id"], []).append((r["ord"], r["start"], r["end"], r["span"]))
    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end(), m.group(0)) for k, m in enumerate(ALL.finditer(t))]
        assert sorted(got.get(i, [])) == want
    kept = {r["doc_id"] for r in spans.clean(table(spark, texts)).collect()}
    assert kept == {i for i, t in enumerate(texts) if not ALL.search(t)}


def test_literal_cases(spark):
    cases = {
        "123-45-6789 then a@b.co": ("123-45-6789", "match:" + P.EMAIL, 11),
        "a@b.co.uk": ("a@b.co.uk", "match:" + P.EMAIL, 6),
        "id 123-45-67890": ("123-45-6789", "match:" + P.SSN, 14),
        "1234-5678-9012-3456": ("1234-5678-9012-3456", "match:" + P.CARD, 19),
        "a@b.c": (None, "ok", None),
    }
    df = table(spark, list(cases))
    body = F.col("text")
    rows = df.select("text", P.leftmost(body), P.first_reason(body), P.first_completion(body)).collect()
    for r in rows:
        assert tuple(r)[1:] == cases[r["text"]]


def test_eligibility_bounds(spark):
    texts = [" " * n + "a@b.co" for n in (19, 20, 2000, 2001)]
    got = {r["doc_id"]: r["prompt"] for r in preparation.pii_prompts(table(spark, texts)).collect()}
    assert {k: len(v) for k, v in got.items()} == {1: 20, 2: 2000}


def test_long_run_is_linear(spark):
    text = "a" * 400_000 + " x@y.co"
    df = table(spark, [text])
    assert df.select(P.first_completion(F.col("text"))).first()[0] == len(text)


def test_null_text(spark):
    df = spark.createDataFrame([(1, None)], "doc_id BIGINT, text STRING")
    assert spans.violating(df).count() == 0 and spans.clean(df).count() == 1
    assert spans.eligible(df).count() == 0


def test_scanning_finds_the_matches_of_the_pattern(spark):
    """The linear form against Python's matches of the plain one, also where a match ends inside a run."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1.-_@@ %") for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    texts += ["a@b.coX1@c.de", "a@b.co1@c.de2@e.fg", "x@y.zz@a.bb", "@a.bc", "a@.bc", "123-45-6789a@b.co", None, "ü@b.co ä.a@b.co"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    whole = re.compile(P.alternation())
    got = {}
    for r in spans.spans(df).collect():
        got.setdefault(r["doc_id"], []).append((r["ord"], r["start"], r["end"], r["span"]))
    want = {}
    for i, t in enumerate(texts):
        found = [(k, m.start(), m.end(), m.group()) for k, m in enumerate(whole.finditer(t or ""))]
        if found:
            want[i] = found
    assert {k: sorted(v) for k, v in got.items()} == want
    redacted = {r[0]: r[1] for r in df.select("doc_id", P.redact(F.col("text"))).collect()}
    assert redacted == {i: t if t is None else whole.sub("[PII]", t) for i, t in enumerate(texts)}


def test_long_runs_and_many_matches(spark):
    texts = ["a@b.co " + "x" * 1_000_000, "y" * 500_000 + " z@b.co", "m@b.co " * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING").repartition(3)
    start = time.monotonic()
    counts = {r["doc_id"]: (r["n"], r["e"]) for r in spans.spans(df).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("end").alias("e")).collect()}
    assert counts == {0: (1, 6), 1: (1, 500_007), 2: (100_000, 699_999)}
    assert {r[0] for r in df.select(F.length(P.redact(F.col("text")))).collect()} == {1_000_006, 500_006, 600_000}
    assert time.monotonic() - start < 60
