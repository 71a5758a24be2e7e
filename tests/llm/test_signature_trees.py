"""Components by shingle similarity against all pairs; bounds of the trees; sizes of heads."""

import random
import re
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import SF
from pyspark.sql import functions as F

from fenceline.llm import queries
from fenceline.llm import signature_trees as S


def plain_set(text, width=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered) if x]
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def plain_rows(rows, percent=85):
    """(id, size, component) of rows (id, text): all pairs of different sets."""
    sets = [plain_set(t) for _, t in rows]
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for a, b in combinations(root, 2):
        if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                root[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    return sorted(((i, len(s), least.get(find(s)) if s else i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def got(table, **kw):
    return sorted((tuple(r) for r in S.joined(table, **kw).collect()), key=str)


def families(seed, n=160):
    """Texts of a few originals with edits of all degrees, so that similarities lie around the limit, and shared passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    originals = [[word() for _ in range(rng.choice([3, 12, 30, 60, 120, 400]))] for _ in range(8)]
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(rng.choice(originals))
        for _ in range(rng.randint(0, 1 + len(w) // 25)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.2:
            w += passage
        if rng.random() < 0.2:
            w = [word() for _ in range(rng.randint(30, 90))] + passage
        rows.append((rng.choice([i, i, i, 3]), " ".join(w) if rng.random() < 0.9 else " ".join(w).upper()))
    return rows


def test_families(spark, monkeypatch):
    for seed in range(3):
        rows = families(seed)
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert got(table) == plain_rows(rows), seed
        # The stages one by one must find what the others leave.
        if seed == 1:
            monkeypatch.setattr(S, "BLOCK", 4)
            monkeypatch.setattr(S, "ROUTES", 1)
            monkeypatch.setattr(S, "FAN", 2)
            monkeypatch.setattr(S, "LEAF", 3)
            monkeypatch.setattr(S, "LEADS", 2)
            assert got(table) == plain_rows(rows)
            monkeypatch.setattr(S, "spanning_links", lambda *a: [])
            assert got(table) == plain_rows(rows)


def test_awkward_rows(spark, docs, empty):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == plain_rows(rows)
    clashing = docs.select("doc_id", "text", F.lit("x").alias("fp"), F.lit(1).alias("n"), F.lit("y").alias("component_id"))
    assert got(clashing) == plain_rows(rows)
    assert got(empty) == []
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "")], "doc_id long, text string")
    assert got(nothing) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 0, None)], key=str)


def test_one_large_group(spark):
    """Thousands of copies with a change each, and words that all texts share."""
    words = [f"v{i}" for i in range(150)]
    rows = [(i, " ".join([*words[: i % 140], f"x{i}", *words[i % 140 + 1 :]])) for i in range(1500)]
    rows += [(5000 + i, " ".join([f"y{i}_{k}" for k in range(60)] + words[:40])) for i in range(50)]
    found = got(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert {c for i, _, c in found if i < 5000} == {0}
    assert all(c == i for i, _, c in found if i >= 5000)


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op11_signature_trees(spark, SF).collect()), key=str) == plain_rows(rows)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.data())
def test_heads_share_enough(n, data):
    """For sets around the limit: the heads of a linked pair share what both sides count on."""
    rng = random.Random(data.draw(st.integers(0, 10**6)))
    m = data.draw(st.integers(n, -(-n * 100 // 85)))
    for both in range(min(n, m), 0, -1):
        if 100 * both < 85 * (n + m - both):
            break
        pool = rng.sample(range(10**6), n + m - both)
        a, b = sorted(pool[:n]), sorted(pool[n - both :])
        shared = len(set(a[: S.head_size(n, 85)]) & set(b[: S.head_size(m, 85)]))
        assert shared >= max(S.least_shared(n, 85), S.least_shared(m, 85))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_no_linked_pair_is_pruned(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64) for _ in range(4)]
    sets = []
    for _ in range(30):
        own = base[rng.integers(4)]
        own = own[rng.random(len(own)) > rng.random() * 0.2]
        sets.append(np.unique(np.r_[own, rng.integers(0, 1 << 63, rng.integers(0, 1 + len(own) // 8), dtype=np.uint64)]))
    sets = [s for s in sets if len(s)]
    sizes = np.array([len(s) for s in sets])
    bits = [S.bitmap(s, int(w)) for s, w in zip(sets, S.width_of(sizes), strict=True)]
    comps = rng.integers(0, 12, len(sets))
    found = {frozenset(p) for i, j in S.candidate_pairs(sizes, bits, comps, 85) for p in zip(i.tolist(), j.tolist(), strict=True)}
    few = {frozenset(p) for p in S.leaf_pairs(sizes.tolist(), [b.tobytes() for b in bits], comps.tolist(), 85)}
    for i, j in combinations(range(len(sets)), 2):
        if comps[i] != comps[j] and S.linked(sets[i], sets[j], 85):
            assert frozenset((i, j)) in found and frozenset((i, j)) in few
