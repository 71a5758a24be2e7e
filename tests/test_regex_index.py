"""The index of literals against trying every expression on every text."""

import random
import re

import pytest

from fenceline import session
from fenceline.operators import constraints as K
from fenceline.operators import regex_index as R

SCHEMA = K.CONSTRAINTS


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [
        ("hello[a-z]+ world", " world"), ("(foo)bar+", "fooba"), ("x{2,}yyy", "yyy"), ("(abc){2}d", "abc"), (r"ab\.cd", "ab.cd"), (r"\bword\b", "word"),
        ("(?!foobar)xyz", "xyz"), ("colou?rful", "colo"), (r"abc\d+defgh", "defgh"), ("(?:ab(?:cde))f", "abcdef"), ("(?:(?:abcd|x)y)+efg", "efg"), ("abc*def", "def"),
        # Without one: nothing needed, too short, other letters match as well, or read differently by the engines.
        ("a|b", None), ("[0-9]{3}-[0-9]", None), ("(?i)hello", None), ("abc?", None), (r"\Qabcd\E", None), ("(abcd)?", None), ("(?:foo|bar)", None), ("(", None), (r"\012abc", None), ("", None),
    ],
)
def test_required_literal(pattern, literal):
    assert R.required_literal(pattern) == literal


def test_every_match_holds_the_literal():
    rng = random.Random(3)
    atoms = ["ab", "c", "(?:de|f)", "[gh]", "i+", "j*", "(?:kl)?", r"\.", "(mno)", "(?:pq){2}", "r{0,2}", "."]
    for _ in range(400):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 6)))
        literal = R.required_literal(pattern)
        for _ in range(20):
            text = "".join(rng.choice("abcdefghijklmnopqr.") for _ in range(3)) + "abcdemnopqpq.iikl" + "".join(rng.choice("abcdefghmnopq.") for _ in range(12))
            for m in re.finditer(pattern, text):
                assert literal is None or literal in m[0]


def made(n):
    rng = random.Random(8)
    words = [f"w{a}{b}{c}x" for a in "abc" for b in "defgh" for c in "klmnopqr"]
    patterns = [f"{rng.choice(words)} {rng.choice(['[a-z]+', 'wa.', '(?:wb|wc)'])}" for _ in range(n)] + ["[0-9]{4}", "a|zz", "(?i)WADKX"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(150)] + [None, "", "1234 wadkx"]
    return patterns, texts + texts[:10]


def test_index_equals_the_loop(spark, monkeypatch):
    patterns, texts = made(300)
    rows = [(f"c{i // 2}", i, "regex", p, -float(i // 2)) for i, p in enumerate(patterns)]
    rows += [("t", 900, "term", "wadkx", None), ("n", 901, "regex", None, 1.0)]
    docs = spark.createDataFrame([(i % 140, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    want = {(i % 140, c, p or 0.0) for i, t in enumerate(texts) if t is not None for c, _, k, r, p in rows if r and (re.search(r, t) if k == "regex" else r in t)}
    table = spark.createDataFrame(rows, SCHEMA)
    for bound in (2_000_000, 20):  # broadcast and shuffled
        monkeypatch.setattr(session, "BROADCAST_MAX_ROWS", bound)
        found = K.hits(docs, table)
        assert found.count() == len(want) and {tuple(r) for r in found.collect()} == want
    # A few conditions only, for the expressions without a literal.
    assert found._jdf.queryExecution().toString().count("RLIKE") < 40
    summed = {(r["text"], round(r["penalty"], 6)) for r in K.with_penalty(docs, table).collect()}
    by_text = {}
    for i, c, p in {(t, c, p or 0.0) for t in texts if t is not None for c, _, k, r, p in rows if r and (re.search(r, t) if k == "regex" else r in t)}:
        by_text[i] = by_text.get(i, 0.0) + p
    assert summed == {(t, round(by_text.get(t, 0.0), 6)) for t in texts}


@pytest.mark.parametrize(
    ("pattern", "parts"),
    [
        ("hello[a-z] world", ("hello", "[a-z] world")), (r"ab\.cd(?:e|f)", ("ab.cd", "(?:e|f)")), ("colou?r", ("colo", "u?r")), ("worda?[,.]? [a-z]*(?:ed|ing)", ("word", "a?[,.]? [a-z]*(?:ed|ing)")),
        # Not one behind the other, nothing needed behind it, or a rest that would be long to try at every place.
        ("hello a|hello b", None), ("hello", None), ("hello(?:x)?", None), ("hello[a-z]*x", None), ("hello(?=x)", None), ("hello[]x]y", None), ("ab[cd]", None), ("(?i)hello[a]", None),
    ],
)
def test_lead_and_rest(pattern, parts):
    assert R.lead_and_rest(pattern) == parts


def test_a_common_rest_is_scanned_for(spark, monkeypatch):
    """Expressions that go on alike are not tried one by one, and give the rows of the loop."""
    rng = random.Random(5)
    words = ["".join(rng.choice("ab\u00e9\U0001f600") for _ in range(rng.randint(3, 9))) for _ in range(150)] + ["abababababababab" * 2]
    rests = ["[,.]? [a-z]*(?:ed|ing)", "(?:a|b)\u00e9", r"[.]\b"]
    rows = [(f"c{i}", i, "regex", w + rests[i % 3], -float(i)) for i, w in enumerate(words * 3)]
    texts = ["".join(rng.choice([" ", ".", ", ", " aed", " bing", rng.choice(words), "\n", "a\u00e9", "b"]) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    texts += [None, "", words[-1] + " ed", words[-1] + "ed", texts[0]]
    docs = spark.createDataFrame([(i % 290 or None, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    want = {(i % 290 or None, c, p) for i, t in enumerate(texts) if t is not None for c, _, _, r, p in rows if re.search(r, t)}
    monkeypatch.setattr(R, "_tried", None)
    for bound in (2_000_000, 20):  # broadcast and shuffled
        monkeypatch.setattr(session, "BROADCAST_MAX_ROWS", bound)
        assert {tuple(r) for r in K.hits(docs, spark.createDataFrame(rows, SCHEMA)).collect()} == want
    assert len(want) > 300


def test_a_rest_is_not_tried_inside_a_character(spark, monkeypatch):
    monkeypatch.setattr(R, "SHARED", 1)
    rows = spark.createDataFrame([("c", "wh\\?[^a]x", 1.0), ("d", "wh\U0001f600[^a]", 2.0)], "constraint_id STRING, pattern STRING, penalty DOUBLE")
    docs = spark.createDataFrame([(1, "wh\U0001f600x"), (2, "wh?\U0001f600x")], "doc_id INT, text STRING")
    assert sorted(tuple(r) for r in R.hits(docs, rows).collect()) == [(1, "d", 2.0), (2, "c", 1.0)]
