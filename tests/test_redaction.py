"""Unions of spans and redaction against literal versions."""

import random
import re
import time

from pyspark.sql import functions as F

from fenceline.functions import patterns as P
from fenceline.operators import redaction as R
from fenceline.operators import terms as T


def plain_union(spans):
    out = []
    for s, e in sorted({x for x in spans if x[0] < x[1]}):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def plain_redact(text, terms):
    if text is None:
        return None
    spans = [m.span() for m in re.finditer(P.alternation(), text)]
    spans += [(i, i + len(t)) for t in terms for i in range(len(text)) if text.startswith(t, i)]
    out, at = "", 0
    for s, e in plain_union(spans):
        out, at = out + text[at:s] + "[X]", e
    return out + text[at:]


def test_union(spark):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        for _ in range(rng.randint(0, 40)):
            s = rng.randint(0, 120)
            rows.append((k, s, s + rng.choice([0, 1, 1, 2, 3, 8, 50])))
    want = {(k, s, e) for k in range(40) for s, e in plain_union([r[1:] for r in rows if r[0] == k])}
    table = spark.createDataFrame(rows, "k INT, start INT, end INT").repartition(3)
    for cell in (1, 7, 4096):
        got = R.union(table, ["k"], cell).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def lexicon(spark, terms, literals):
    return T.lexicon(spark.createDataFrame([(t,) for t in terms], "term STRING"), T.ENFORCE, literals)


def test_redaction(spark, monkeypatch):
    rng = random.Random(6)
    bits = ["a@b.co", "bad", "adab", "😀", " ", "\n", "123-45-6789", "x", "co", "b.c", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(120)] + [None, "", "bad", "badadab"]
    rows = [(rng.choice([None, 1, 2, i]), t) for i, t in enumerate(texts + texts[:20])]
    docs = spark.createDataFrame(rows, "doc_id INT, text STRING")
    terms = ["bad", "adab", "co", "😀x"]
    want = sorted(((k, plain_redact(t, terms)) for k, t in rows), key=str)
    for literals, block in ((0, 4096), (100, 4096), (0, 5)):
        monkeypatch.setattr(T, "BLOCK_CHARS", block)
        got = R.redact_all(docs, lexicon(spark, terms, literals)).select("doc_id", "redacted").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_many_spans_in_one_text(spark):
    text = "bad word " * 100_000
    docs = spark.createDataFrame([(1, text)], "doc_id INT, text STRING")
    start = time.perf_counter()
    got = R.redact_all(docs, lexicon(spark, ["bad"], 0)).select("redacted").first()[0]
    assert got == text.replace("bad", "[X]")
    assert time.perf_counter() - start < 90


def test_no_spans(spark):
    docs = spark.createDataFrame([(1, "fine")], "doc_id INT, text STRING")
    assert [tuple(r) for r in R.redact_all(docs, lexicon(spark, ["bad"], 0)).collect()] == [(1, "fine", "fine")]
    assert R.redact_all(docs.filter(F.lit(False)), lexicon(spark, ["bad"], 0)).count() == 0
