"""Periodic runs against a plain search of every period."""

import re
from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import SF

from fenceline.llm import periodic, queries


def plain_runs(w):
    """All runs by trying every period and place."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            b = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - b
            if length >= max(6, 4 * q) and not any(p in found.get((b, length), ()) for p in range(1, q)):
                # A smaller period of the same stretch makes q no smallest period.
                if not any(q % p == 0 and all(w[j] == w[j + p] for j in range(b, b + length - p)) for p in range(1, q)):
                    found.setdefault((b, length), []).append(q)
    return sorted((b, n_, q) for (b, n_), qs in found.items() for q in qs)


def plain_row(key, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    if loop := periodic.looped(key, len(w)):
        a, p = loop
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = sorted(plain_runs(w), key=lambda x: (x[0], x[2]))
    best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if found else (None, None, None)
    drop = {i for b, n, q in found for i in range(b + q, b + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    milli = 1000 * best[1] // best[2] if found else None
    lines = "".join(f"{b},{n},{q}\n" for b, n, q in found)
    return (len(found), *best, milli, sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

pieces = st.lists(st.integers(0, 2), min_size=1, max_size=9).flatmap(lambda u: st.integers(1, 9).map(lambda k: u * k))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(pieces, max_size=6).map(lambda x: [w for p in x for w in p]), max_size=4))
def test_runs_of_texts(texts):
    got = periodic.runs_of([np.array(t, dtype=np.int64) for t in texts])
    assert got == [sorted(plain_runs(t), key=lambda x: (x[0], x[2])) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=6).map(lambda x: [w for p in x for w in p]))
def test_grammar_alone_finds_the_runs(text):
    """Without the cut into stretches."""
    begin, stop, q = periodic.runs(np.array(text), np.zeros(len(text), dtype=np.int64))
    assert sorted(zip(begin.tolist(), (stop - begin).tolist(), q.tolist(), strict=True)) == plain_runs(text)


def test_grammar_derives_its_places():
    rng = np.random.default_rng(5)
    word = np.tile(rng.integers(0, 9, 40), 12)
    g = periodic.Grammar(word, np.zeros(len(word), dtype=np.int64))
    assert len(g.place) == len(word) - 1  # a binary tree
    for node, place in zip(g.node, g.place, strict=True):
        size = g.end[node] - g.start[node]
        assert (word[place : place + size] == word[g.start[node] : g.end[node]]).all()
    assert len(g.start) < len(word) // 3  # repeated parts are one node


def test_long_loop_and_awkward_texts(spark):
    rng = np.random.default_rng(2)
    block = [f"w{i}" for i in rng.integers(0, 3000, 5000)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    texts = [" ".join(block * 5), "a " * 20_000, " ".join(fib[-1]), "x y " * 7, "a\x1cb a\x1cb " * 4, "a\x0ba\x0ca\ra\na\ta ", "", None, " \n", "ä b " * 4]
    rows = [(i * 2 + 1, t, "s", 1) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_runs string, `start` int")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in periodic.detected(table).collect()}
    assert got[1][1:4] == (0, 25_000, 5000) and got[1][0] == 1
    assert got[3][1:5] == (0, 20_000, 1, 20_000_000)
    for i, t in rows_without_loops(rows[3:]):
        assert got[i] == plain_row_unlooped(t), (i, t)
    # A Fibonacci word has no power of four.
    assert got[5][0] == 0


def rows_without_loops(rows):
    return [(r[0], r[1]) for r in rows]


def plain_row_unlooped(text):
    return plain_row(None, text)


def test_rows_of_the_table_and_of_awkward_rows(spark, docs, empty):
    for table in (docs.select("doc_id", "text", "row"), spark.read.parquet(f"{SF}/documents.parquet")):
        rows = table.select("doc_id", "text").collect()
        # The plain search is slow: short texts all, long ones only where they loop.
        small = {(r["doc_id"], r["text"]) for r in rows if len((r["text"] or "").split()) <= 700}
        got = periodic.detected(table, change=periodic.looped).collect()
        assert len(got) == len(rows)
        plain = {}
        for key, text in small:
            plain.setdefault(key, []).append(plain_row(key, text))
        for r in got:
            if r["doc_id"] in plain and len(plain[r["doc_id"]]) == 1:
                assert tuple(r[c] for c in COLUMNS) == plain[r["doc_id"]][0], r["doc_id"]
    assert periodic.detected(empty, change=periodic.looped).count() == 0


def test_looped_texts_have_runs(spark):
    got = queries.op13_grammar_runs(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    loops = 0
    for r in got:
        n = len((texts[r["doc_id"]] or "").split())
        loop = periodic.looped(r["doc_id"], n)
        if loop and n - loop[0] >= max(6, 4 * loop[1]):
            loops += 1
            assert r["n_runs"] > 0
    assert loops
