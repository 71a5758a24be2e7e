"""Token tables with small blocks against scans of the joined text."""

import random
import re

from pyspark.sql import functions as F

from fenceline.functions import patterns as P
from fenceline.operators import running, sequences
from fenceline.operators import terms as T

SCHEMA = "seq_id BIGINT, pos BIGINT, piece STRING"


def random_sequences(n, seed, bits):
    rng = random.Random(seed)
    return [[rng.choice(bits) for _ in range(rng.randint(1, 60))] for _ in range(n)]


def table(spark, sequences_):
    rows = [(s, i, p) for s, pieces in enumerate(sequences_) for i, p in enumerate(pieces)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(8)


def completing_piece(pieces, regex):
    text = ""
    for i, p in enumerate(pieces):
        text += p
        if re.search(regex, text):
            return i
    return None


BITS = ["a", "b", "@", ".", "c", "o", ".co", "-", "1", "12", "123-", "45-", "6789", "a@b", "dddddddddddddddddddd", " ", "é"]


def test_first_completions(spark):
    seqs = random_sequences(600, 4, BITS)
    # Domains that run over many blocks, whole ones included, and a completion far behind the start.
    for n in (1, 17, 18, 19, 20, 37, 55, 90, 200):
        for head in (["x", "@"], ["x@"], ["x", "@", "."], [" ", "@"], ["x", "@", " "]):
            for tail in ([".", "c", "o"], [".", "c", ".", "c", "o"], [".co"], [" ", ".co"]):
                seqs.append(["q"] * (n % 7) + head + ["d"] * n + tail + ["z"] * 30)
                seqs.append(["1"] * (n % 5) + head + ["d."] * n + tail)
    for block in (1, 40):
        got = {(r["seq_id"], r["pattern"]): r["pos"] for r in sequences.first_completions(table(spark, seqs), block=block).collect()}
        want = {}
        for s, pieces in enumerate(seqs):
            for p in P.PII:
                pos = completing_piece(pieces, p.regex)
                if pos is not None:
                    want[(s, p.name)] = pos
        assert got == want


def test_terms(spark):
    seqs = random_sequences(400, 5, ["a", "b", "ab", "c", "abc", " ", "é"])
    terms = ["abab", "cab", "bcabc", "éa", "ababab c"]
    words = spark.createDataFrame([(t,) for t in terms], "term STRING")
    want = {}
    for s, pieces in enumerate(seqs):
        pos = completing_piece(pieces, "|".join(map(re.escape, terms)))
        if pos is not None:
            want[s] = pos
    for bound in (100, 0):
        for block in (1, 9, 1000):
            found = sequences.first_term_completions(table(spark, seqs), T.lexicon(words, T.ENFORCE, bound), block)
            assert {r["seq_id"]: r["pos"] for r in found.collect()} == want


def test_running(spark):
    rng = random.Random(6)
    rows = [(k, v * 3 + k) for k in range(5) for v in rng.sample(range(200), 90)]
    df = spark.createDataFrame(rows, "k INT, at BIGINT")
    got = {(r["k"], r["at"]): r["pos"] for r in running.position(df, ["k"], "at", cell=16).collect()}
    for k in range(5):
        for i, at in enumerate(sorted(a for kk, a in rows if kk == k)):
            assert got[(k, at)] == i
    ids = spark.createDataFrame([(i * i - 50,) for i in range(300)], "id BIGINT").repartition(7)
    got = sorted((r["id"], r["idx"], r["batch_id"]) for r in running.batches(ids, "id", 32, fan=3).collect())
    assert got == [(i * i - 50, i, i // 32) for i in range(300)]
    assert running.batches(ids.limit(0), "id", 32).count() == 0


def test_overlaps(spark):
    rng = random.Random(8)
    tokens, spans = [], []
    for s in range(20):
        at = 0
        for pos in range(80):
            n = rng.randint(1, 30)
            tokens.append((s, pos, at, at + n))
            at += n
        for k in range(12):
            a = rng.randint(0, at - 1)
            spans.append((s, k, a, a + rng.randint(1, 90)))
    t = spark.createDataFrame(tokens, "seq_id BIGINT, pos BIGINT, start BIGINT, end BIGINT")
    s = spark.createDataFrame(spans, "seq_id BIGINT, ord INT, start INT, end INT")
    pairs = sequences.overlapping(t, s, width=16).select("seq_id", "token.pos", "span.ord").collect()
    want = sorted((a[0], a[1], b[1]) for a in tokens for b in spans if a[0] == b[0] and a[2] < b[3] and b[2] < a[3])
    assert sorted(map(tuple, pairs)) == want


def test_offsets(spark):
    seqs = random_sequences(20, 9, ["a", "bb", "é😀"])
    got = {(r["seq_id"], r["pos"]): (r["start"], r["end"]) for r in sequences.with_offsets(table(spark, seqs)).collect()}
    for s, pieces in enumerate(seqs):
        at = 0
        for i, p in enumerate(pieces):
            assert got[(s, i)] == (at, at + len(p))
            at += len(p)


def test_prompt_is_not_scanned(spark):
    rows = [(0, 0, "a@b", True), (0, 1, ".co", False), (1, 0, "x", True), (1, 1, "a@b", False), (1, 2, ".co", False)]
    df = spark.createDataFrame(rows, SCHEMA + ", is_prompt BOOLEAN")
    found = sequences.first_completions(sequences.generated(df)).select(F.col("seq_id"), "pos").collect()
    assert [tuple(r) for r in found] == [(1, 2)]
