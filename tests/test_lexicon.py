"""Lexicon states and vocabulary tables against stepping through texts character by character."""

import random

from pyspark.sql import functions as F

from fenceline import session
from fenceline.operators import lexicon as L
from fenceline.operators import terms as T

TERMS = ["he", "she", "his", "hers", "ushers"]


def words(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term STRING")


def prefixes(terms):
    return {t[:i] for t in terms for i in range(len(t) + 1)}


def longest_state(text, states):
    return next(text[i:] for i in range(len(text) + 1) if text[i:] in states)


def test_states_and_links(spark):
    df, states = words(spark, TERMS), prefixes(TERMS)
    assert {tuple(r) for r in L.states(df).collect()} == {(s, len(s)) for s in states}
    want = {s: longest_state(s[1:], states) for s in states if s}
    assert {r["state"]: r["failure"] for r in L.failure_links(df).collect()} == want
    got = {r["state"] for r in L.forbidden_states(df).collect()}
    assert got == {s for s in states if any(s.endswith(t) for t in TERMS)}


def test_state_table(spark):
    rng = random.Random(7)
    for terms, bound in ((TERMS, 99), (["ab", "bab", "aa", "cabb"], 99), (["abc", "bcd", "cc"], 99), (TERMS, 0)):
        letters = sorted(set("".join(terms)))
        pieces = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"</s>"}
        vocabulary = spark.createDataFrame([(p,) for p in pieces], "piece STRING")
        rows = L.state_table(words(spark, terms), vocabulary, "</s>", bound).collect()
        assert len({(r["state"], r["piece"]) for r in rows}) == len(rows)
        table = {(r["state"], r["piece"]): (r["blocked"], r["next_state"]) for r in rows}
        states = {s for s in prefixes(terms) if not any(t in s for t in terms)}
        for state in states:
            for piece in pieces:
                got = table.get((state, piece), table[("", piece)])
                joined = state + piece
                blocked = piece != "</s>" and any(t in joined for t in terms)
                assert got == (blocked, None if blocked else longest_state(joined, states)), (state, piece)


def test_blocked_alone(spark):
    vocabulary = spark.createDataFrame([("ushers",), ("a@b.co",), ("ok",), ("he",)], "piece STRING")
    for bound in (10, 0):
        lex = T.lexicon(words(spark, TERMS), T.ENFORCE, bound)
        got = {tuple(r) for r in L.blocked_alone(vocabulary, lex).collect()}
        assert got == {("ushers", True, False), ("a@b.co", False, True), ("he", True, False)}


def test_base_pieces(spark):
    vocabulary = spark.createDataFrame([(p,) for p in ("a", "b", "c", "ab", "abc")], "piece STRING")
    merges = spark.createDataFrame([("a", "b"), ("ab", "c")], "prefix STRING, suffix STRING")
    assert {r[0] for r in L.base_pieces(merges, vocabulary).collect()} == {"a", "b", "c"}
    assert tuple(L.base_piece_check(merges, vocabulary).first()) == (5, 3, 2, 0, True)
    broken = spark.createDataFrame([("a", "b"), ("x", "c")], "prefix STRING, suffix STRING")
    row = L.base_piece_check(broken, vocabulary).first()
    assert row["n_missing_parts"] == 1 and not row["adds_up"]


def test_mask_on_candidates(spark):
    """State of a context, then the mask, against containment in the joined text."""
    rng = random.Random(9)
    letters = "ehrsiux"
    pieces = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(40)}) + ["</s>"]
    contexts = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(60)})
    contexts = [c for c in contexts if not any(t in c for t in TERMS)]
    rows = [(c, p) for c in contexts for p in [*rng.sample(pieces, 12), "</s>", "unseen"]]
    vocabulary = spark.createDataFrame([(p,) for p in pieces], "piece STRING")
    table = L.state_table(words(spark, TERMS), vocabulary, "</s>")
    pairs, states = spark.createDataFrame(rows, "text STRING, piece STRING"), prefixes(TERMS)
    found = L.state_of(pairs, words(spark, TERMS))
    joined = L.state_of(pairs, words(spark, TERMS), literal_terms=0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, joined.select(found.columns).collect()))
    got = L.with_mask(found, table, "</s>").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["state"] == longest_state(r["text"], states)
        blocked = r["piece"] not in ("</s>", "unseen") and any(t in r["text"] + r["piece"] for t in TERMS)
        assert r["blocked"] == blocked
        if not blocked and r["piece"] != "unseen":
            assert r["next_state"] == longest_state(r["text"] + r["piece"], states)


def test_a_mask_beyond_the_broadcast_bound_reads_its_candidates_once(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_MAX_ROWS", 0)
    rows = [("", "ab", False, "b"), ("", "c", True, None), ("a", "ab", True, None)]
    table = spark.createDataFrame(rows, "state STRING, piece STRING, blocked BOOLEAN, next_state STRING")
    state = F.when(F.col("id") % 2 == 0, "a").otherwise("")
    pieces = spark.range(6).select("id", state.alias("state"), F.element_at(F.array(F.lit("ab"), F.lit("c"), F.lit("d")), (F.col("id") % 3 + 1).cast("int")).alias("piece"))
    masked = L.with_mask(pieces, table)
    assert masked.columns == ["state", "piece", "id", "blocked", "next_state"]
    assert {(r["id"], r["blocked"], r["next_state"]) for r in masked.collect()} == {
        (0, True, None), (1, True, None), (2, False, None), (3, False, "b"), (4, True, None), (5, False, None)
    }
    assert "Range (" not in masked._jdf.queryExecution().toString()
