"""Candidate operators against their literal definitions."""

import math
import random
from collections import defaultdict

from fenceline.operators import candidates as C

SCHEMA = "seq_id STRING, step INT, cand STRING, logit DOUBLE, is_eos BOOLEAN"


def steps(seed=10, n=120):
    rng = random.Random(seed)
    rows = []
    for s in range(n):
        for c in range(rng.randint(1, 12)):
            rows.append((f"s{s}", s % 3, f"c{c}", rng.choice([0.0, 0.5, 1.0, 1.25, 2.0, 3.0]), c == 0))
    return rows


def grouped(rows):
    out = defaultdict(list)
    for r in rows:
        out[(r[0], r[1])].append(r)
    return out


def softmax(logits):
    top = max(logits)
    e = [math.exp(x - top) for x in logits]
    return [x / sum(e) for x in e]


def test_topk_and_topp(spark):
    rows = steps()
    df = spark.createDataFrame(rows, SCHEMA)
    for k in (0, 1, 3):
        got = {(r["seq_id"], r["step"], r["cand"]) for r in C.top_k(df, k).collect()}
        want = set()
        for key, group in grouped(rows).items():
            values = sorted((r[3] for r in group), reverse=True)
            limit = values[min(k, len(values)) - 1] if k > 0 else -math.inf
            want |= {(*key, r[2]) for r in group if r[3] >= limit}
        assert got == want
    for p in (0.0, 0.33, 0.71, 1.0):
        got = {(r["seq_id"], r["step"], r["cand"]) for r in C.top_p(df, p).collect()}
        want = set()
        for key, group in grouped(rows).items():
            ranked = sorted(group, key=lambda r: (-r[3], r[2]))
            mass = 0.0
            for i, (r, q) in enumerate(zip(ranked, softmax([r[3] for r in ranked]))):
                if i == 0 or mass <= p or p >= 1.0:
                    want.add((*key, r[2]))
                mass += q
        assert got == want


def test_topp_by_bins_and_by_texts(spark, monkeypatch):
    """Steps with more levels than bins, levels too large to be ordered, steps far below the others, masked candidates."""
    monkeypatch.setattr(C, "LAST_BIN", 3)
    monkeypatch.setattr(C, "BINS_PER_UNIT", 2)
    monkeypatch.setattr(C, "SORTED", 2)
    rows = [(s, t, c, x - (2000.0 if s == "s5" else 0.0), e) for s, t, c, x, e in steps(3, 60)]
    rows += [("none", 0, "a", -math.inf, False), ("none", 0, "b", -math.inf, False), ("some", 0, "a", -math.inf, False), ("some", 0, "b", 1.0, False)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k, p in ((0, 0.0), (0, 0.4), (3, 0.55), (0, 0.9)):
        got = sorted((r["seq_id"], r["step"], r["cand"]) for r in C.top_p(df, p, k=k).collect())
        want = []
        for key, group in grouped(rows).items():
            ranked = sorted(group, key=lambda r: (-r[3], r[2]))
            if k:
                ranked = [r for r in ranked if r[3] >= ranked[min(k, len(ranked)) - 1][3]]
            if ranked[0][3] == -math.inf:
                want.append((*key, ranked[0][2]))
                continue
            mass = 0.0
            for i, (r, q) in enumerate(zip(ranked, softmax([r[3] for r in ranked]))):
                if i == 0 or mass <= p:
                    want.append((*key, r[2]))
                mass += q
        assert got == sorted(want), (k, p)


def test_literal_cases(spark):
    df = spark.createDataFrame([("s", 0, f"c{i}", x, False) for i, x in enumerate([3.0, 2.0, 2.0, 1.0])], SCHEMA)
    assert sorted(r["logit"] for r in C.top_k(df, 2).collect()) == [2.0, 2.0, 3.0]
    probs = [0.5, 0.3, 0.2]
    df = spark.createDataFrame([("s", 0, f"c{i}", math.log(x), False) for i, x in enumerate(probs)], SCHEMA)
    assert C.top_p(df, 0.55).count() == 2 and C.top_p(df, 0.1).count() == 1


def test_log_softmax_greedy_and_scores(spark):
    rows = steps(11)
    df = spark.createDataFrame(rows, SCHEMA)
    scored = {(r["seq_id"], r["cand"]): r["logprob"] for r in C.log_softmax(C.temperature(df, 0.5)).collect()}
    picks = {r["seq_id"]: r["picked"] for r in C.greedy(df).collect()}
    chosen = {r["seq_id"]: r["logprob"] for r in C.chosen_logprob(df, C.greedy(df)).collect()}
    for (s, _), group in grouped(rows).items():
        for r, q in zip(group, softmax([x[3] / 0.5 for x in group])):
            assert math.isclose(scored[(s, r[2])], math.log(q), abs_tol=1e-9)
        best = min(group, key=lambda r: (-r[3], r[2]))
        assert picks[s] == best[2]
        assert math.isclose(chosen[s], math.log(softmax([r[3] for r in group])[group.index(best)]), abs_tol=1e-9)
    sums = C.sequence_scores(spark.createDataFrame([("a", -1.0), ("a", -3.0)], "seq_id STRING, logprob DOUBLE")).first()
    assert tuple(sums)[:3] == ("a", 2, -4.0) and math.isclose(sums["perplexity"], math.exp(2))


def test_sample_follows_the_probabilities(spark):
    rows = [(f"s{i}", 0, c, math.log(p), False) for i in range(4000) for c, p in (("x", 0.7), ("y", 0.2), ("z", 0.1))]
    df = spark.createDataFrame(rows, SCHEMA)
    picks = [r["picked"] for r in C.sample(df, 1).collect()]
    assert abs(picks.count("x") / 4000 - 0.7) < 0.03 and abs(picks.count("z") / 4000 - 0.1) < 0.02
    again = {r["seq_id"]: r["picked"] for r in C.sample(df.repartition(5), 1).collect()}
    assert sorted(again.values()) == sorted(picks)


def test_mask_penalty_and_audit(spark):
    rows = [("s", 0, "a", 2.0, False, True), ("s", 0, "b", 1.0, False, False), ("s", 0, "</s>", 1.0, True, True)]
    df = spark.createDataFrame(rows, SCHEMA + ", blocked BOOLEAN")
    masked = {r["cand"]: r["logit"] for r in C.mask(df).collect()}
    assert masked == {"a": -math.inf, "b": 1.0, "</s>": 1.0}
    audit = C.mask_audit(df).first()
    assert (audit["n_cands"], audit["n_blocked"], audit["greedy_before"], audit["greedy_after"]) == (3, 1, "a", "</s>")
    assert math.isclose(audit["removed_mass"], softmax([2.0, 1.0, 1.0])[0])
    rows = [("s", 0, "a", -5.0), ("s", 0, "a", -1.0), ("s", 0, "b", -2e6), ("s", 0, "</s>", -9.0)]
    penalties = spark.createDataFrame(rows, "seq_id STRING, step INT, cand STRING, penalty DOUBLE")
    got = {r["cand"]: r["score"] for r in C.penalised(df, penalties).collect()}
    assert got == {"a": -4.0, "b": -math.inf, "</s>": 1.0}


def test_best_completions(spark):
    rng = random.Random(12)
    rows = [(0 if i % 3 else i % 5, i, float(rng.randint(-20, 0))) for i in range(900)]
    df = spark.createDataFrame(rows, "prompt_id BIGINT, gen_id BIGINT, sum_logprob DOUBLE")
    got = {(r["prompt_id"], r["rank"]): r["gen_id"] for r in C.best_completions(df, 4, salts=3).collect()}
    for prompt in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == prompt), key=lambda r: (-r[2], r[1]))[:4]
        for i, r in enumerate(ranked):
            assert got[(prompt, i + 1)] == r[1]


def test_penalties_are_looked_up_without_a_shuffle_of_the_candidates(spark):
    rows = [(1, 0, "a", 1.0, False), (1, 0, "b", 2.0, False), (None, 0, "c", 3.0, False)]
    candidates = spark.createDataFrame(rows, "seq_id INT, step INT, cand STRING, logit DOUBLE, is_eos BOOLEAN")
    penalties = spark.createDataFrame([(1, 0, "b", -1.0), (1, 0, "b", -0.5)], "seq_id INT, step INT, cand STRING, penalty DOUBLE")
    scored = C.penalised(candidates, penalties)
    assert {(r["cand"], r["score"]) for r in scored.collect()} == {("a", 1.0), ("b", 0.5), ("c", 3.0)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Exchange hashpartitioning" not in C.penalised(candidates, penalties)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_texts_are_shuffled_once(spark, tmp_path):
    """The ends of steps come from the shuffle of the scores; a word that looks like an end stays a candidate of its own."""
    from fenceline.plans import views as V

    rows = [(1, "a b a </s> a b"), (2, "a"), (3, None), (4, "b  a"), (None, "a b")]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    df = V.candidates(spark, str(tmp_path))
    got = sorted((r["seq_id"], r["cand"], round(r["logit"], 6), r["is_eos"]) for r in df.collect())
    want = [("a", "b", 1.098612, False), ("b", "a", 0.0, False), ("a", "</s>", 0.0, False), ("</s>", "a", 0.0, False), ("b", "", 0.0, False), ("", "a", 0.0, False)]
    assert got == sorted(want + [(c, "</s>", 0.0, True) for c in ("a", "b", "</s>", "")])
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_an_expression_looks_for_its_literal_first(spark):
    from fenceline.operators import constraints as K

    rows = [("m", 0, "regex", r"[a-z]+@[a-z]+", 1.0), ("n", 1, "regex", "[0-9]{2}|x", 2.0)]
    table = spark.createDataFrame(rows, K.CONSTRAINTS)
    df = K.with_penalty(spark.createDataFrame([("a@b",), ("@",), ("a@b 12",), ("x",), (None,)], "text STRING"), table)
    assert {r["text"]: r["penalty"] for r in df.collect()} == {"a@b": 1.0, "@": 0.0, "a@b 12": 3.0, "x": 2.0, None: 0.0}
    assert "Contains(text" in df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_of_several_tables(spark):
    rows = [("a", -1.5), ("b", -0.25), ("a", -2.0), (None, -3.0), ("b", -0.5), ("c", 0.0)]
    made = [spark.createDataFrame(part, "seq_id STRING, logprob DOUBLE") for part in (rows, rows[:2], rows[2:5], rows[5:])]
    whole, parts = (sorted((tuple(r) for r in df.collect()), key=str) for df in (C.sequence_scores(made[0]), C.sequence_scores(*made[1:])))
    assert whole == parts and len(parts) == 4


def test_pairs_are_counted_once(spark):
    """Penalties and scores read one table of candidates."""
    from fenceline.plans import catalog

    plan = catalog.cand_penalty_join(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Relation" in plan
