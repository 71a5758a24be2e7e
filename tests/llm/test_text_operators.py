"""Operators on single texts against plain versions, on awkward rows and on the given tables."""

import bisect
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from llm_tables import SF, rows_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from fenceline.llm import licenses, packing, quality, queries, rules, token_counts

WORD_BPE = P.path("word_bpe_49k.json")


# --- rules -----------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


EXTRA = ["a b c d e f g h " * 9, "a b c d e f g h i a b c d e f g h x y", "# $ %\n# $ %\n\n \n# $ %", "a\x0bb\x1fc\x0cd", "ä" * 3]


def test_rule_measures(spark, docs):
    own = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(EXTRA)], "doc_id long, text string"))
    got = rules.ledger(own, keep=["doc_id", "text"]).collect()
    assert len(got) == own.count()
    for r in got:
        assert tuple(r[m] for m in rules.MEASUREMENTS) == plain_measures(r["text"]), r["doc_id"]


def test_rule_policies_and_ablation(spark, docs):
    ledger = rules.ledger(docs)
    judged = rules.judged(ledger).collect()
    for r in judged:
        base = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == base and (not base or not r["kept"])
        assert r["kept"] == (r["failed"] & rules.mask("v2") == 0)
    for r in rules.ablation(ledger).collect():
        bit, mask = rules.BIT[r["rule"]], rules.mask("v2")
        assert r["n_failed"] == sum(bool(x["failed"] & bit) for x in judged)
        assert r["n_only"] == sum(x["failed"] & mask == bit for x in judged)
        assert r["n_kept"] == sum(x["kept"] for x in judged)


def test_rules_of_an_empty_table(empty):
    assert rules.judged(rules.ledger(empty)).collect() == []
    assert {r["n_failed"] for r in rules.ablation(rules.ledger(empty)).collect()} == {0}


# --- token counts ----------------------------------------------------------------------------------

ODD = ["a\x0bb\x1cc\x85d e f", "İSTANBUL ΣΑΣ ß", "é ñ", "x<|endoftext|>y <|startoftext|>", "it's we'll 123abc!!", "日本語 テキスト", "﻿ ​ a"]


def test_token_counts(spark, docs, monkeypatch):
    own = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    library = Tokenizer.from_file(WORD_BPE)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in own.collect())
    for cache in (token_counts.CACHE_ROWS, 20):
        monkeypatch.setattr(token_counts, "CACHE_ROWS", cache)
        for table in (token_counts.TABLE_ROWS, 3, 0):
            assert Counter(map(tuple, token_counts.counted(own, WORD_BPE, table_rows=table).collect())) == want


def test_token_counts_of_an_empty_table(empty):
    assert token_counts.counted(empty, WORD_BPE).collect() == []


def test_token_counts_on_given_documents(spark):
    library = Tokenizer.from_file(WORD_BPE)
    texts = rows_of(spark, "documents", "doc_id", "text")
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts}
    got = entry.queries()["op7_two_tier_tokens"](spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)


# --- licences --------------------------------------------------------------------------------------


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit-text"]
    texts = ["x\nReleased under THE mit license\ny", "Licensed under CC BY-NC 4.0", mit + " and more", mit, "", None, "released", "licensed under cc by 4 0\nAll rights reserved.", "x\nReleased under THE mit license\ny z"]
    got = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r["doc_id"]: (r["license"], r["unit"], r["n_matches"], r["licenses"]) for r in got}
    # The second line, and the whole text: 4 of 4 and 6 bigrams are 0.8 exactly. One word more is too much.
    assert found[0] == ("mit", 2, 2, "mit") and found[8] == ("mit", 2, 1, "mit") and found[1] == ("cc-by-nc-4.0", 0, 1, "cc-by-nc-4.0")
    assert found[2][0] == "mit-text" and found[3] == ("mit-text", 0, 1, "mit-text")
    assert all(found[i] == (None, None, 0, "") for i in (4, 5, 6))
    assert found[7][2:] == (2, "all-rights-reserved,cc-by-4.0")
    score = next(r["score"] for r in got if r["doc_id"] == 2)
    a, b = set(licenses.bigrams_of(mit + " and more")), set(licenses.bigrams_of(mit))
    assert score == pytest.approx(2 * len(a & b) / (len(a) + len(b)))


def test_licenses_on_awkward_rows(docs, empty):
    assert licenses.scanned(docs).count() == docs.count()
    assert licenses.scanned(empty).collect() == []
    assert licenses.scanned(docs, templates={}).where("n_matches > 0").count() == 0


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""


def test_published_licenses_wrapped_and_in_prose(spark):
    mit = licenses.PUBLISHED["mit-license"]
    wrapped = {"mit-license": mit, "bsd-2-clause-license": BSD, "gpl-3.0-header": GPL}
    wrapped |= {n: licenses.PUBLISHED[n] for n in ("gpl-3.0-license", "mpl-2.0-license", "lgpl-2.1-license", "apache-2.0-license")}
    prose = "\n".join(" ".join(f"w{i * 7 % 31}x{j}" for j in range(12)) for i in range(40))
    cases = [(name, width, comment, alone) for name in wrapped for width, comment in ((76, ""), (60, " * ")) for alone in (True, False)]
    rows = []
    for i, (name, width, comment, alone) in enumerate(cases):
        body = "\n\n".join(textwrap.fill(" ".join(p.split()), width, initial_indent=comment, subsequent_indent=comment) for p in wrapped[name].split("\n\n"))
        rows.append((i, body if alone else f"{prose}\n\n{body}\n\n{prose}"))
    rows.append((len(cases), f"{prose}\n{mit}\n{prose}\n{mit}\n{prose}"))
    got = {r["doc_id"]: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, _, _, alone) in enumerate(cases):
        # Whole licences hold their own headers, too.
        assert name in got[i]["licenses"].split(",") and got[i]["license"].rsplit("-", 1)[0] == name.rsplit("-", 1)[0], (cases[i], got[i])
        assert alone or got[i]["unit"] > 40
    twice = got[len(cases)]
    assert twice["license"] == "mit-license" and twice["score"] > 0.95 and twice["n_matches"] >= 2


def test_license_runs_against_all_pairs_of_lines():
    rng = np.random.default_rng(3)
    templates = {"a": "one two three four five six seven eight nine ten", "b": "red green blue red green", "c": "x y"}
    known = licenses.prepared(templates, 0.8)
    every = frozenset().union(*(t.bigrams for t in known))
    pool = " ".join(templates.values()).split() + ["", "", "other"]
    for _ in range(400):
        words = list(rng.choice(pool, rng.integers(0, 12))) + templates[rng.choice(["a", "b", "c"])].split() + list(rng.choice(pool, rng.integers(0, 12)))
        text = "".join(w + ("\n" if rng.random() < 0.3 else " ") for w in words)
        lines = text.split("\n")
        found = licenses.matches(text, known, every, 0.8)
        for t in known:
            best = 0.0
            for i in range(len(lines)):
                for j in range(i, len(lines)):
                    w = re.findall(r"[^\W_]+", " ".join(lines[i : j + 1]))
                    own = set(zip(w, w[1:], strict=False))
                    if len(w) <= t.words or i == j:
                        best = max(best, 2 * len(own & t.bigrams) / (len(own) + len(t.bigrams)))
            w = re.findall(r"[^\W_]+", text)
            own = set(zip(w, w[1:], strict=False))
            best = max(best, 2 * len(own & t.bigrams) / (len(own) + len(t.bigrams)))
            scores = [-m[0] for m in found if m[1] == t.name]
            assert max(scores, default=0.0) == (best if best >= 0.8 else 0.0)


# --- quality ---------------------------------------------------------------------------------------


def test_marks():
    assert quality.marked_words("a a b\na a b\n\nc") == ["a", "a", "b", "a", "a", "b", "c", quality.SAME_WORD, quality.SAME_WORD, *[quality.SAME_LINE] * 3]
    assert quality.marked_words("") == []


def test_features_of_words_do_not_depend_on_their_company():
    together, sizes = quality.features(["alpha", "ß", "", "beta"])
    first = np.r_[0, np.cumsum(sizes)]
    for i, w in enumerate(["alpha", "ß", "", "beta"]):
        alone, n = quality.features([w])
        assert n[0] == sizes[i] and sorted(alone) == sorted(together[first[i] : first[i + 1]])


def test_quality_scores(spark, docs, labels, empty):
    model = quality.trained(docs, labels)
    got = quality.scored(docs, model).select("row.*", "score", "predicted")
    again = {(r["doc_id"], r["text"]): r[7] for r in got.collect()}
    assert got.count() == docs.count()
    for (_, text), s in again.items():
        ws = quality.marked_words(text or "")
        z = model.bias + (model.shares[quality.features(ws)[0]].mean() if ws else 0.0)
        assert s == pytest.approx(1 / (1 + np.exp(-z)))
    assert quality.scored(empty, model).collect() == []
    nothing = quality.trained(docs, labels.where("false"))
    assert {r["score"] for r in quality.scored(docs, nothing).select("score").collect()} == {0.5}
    one = quality.trained(docs, labels.where("quality = 1"))
    assert quality.scored(docs, one).where("predicted = 0").isEmpty()


def test_quality_held_out(spark):
    y = dict(rows_of(spark, "labels", "doc_id", "quality"))
    got = entry.queries()["op3_subword_quality"](spark, SF).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    judged = [(r["predicted"], y[r["doc_id"]]) for r in held if r["doc_id"] in y]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)
    assert all(a for a, b in judged if b)


# --- packing ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("case", range(5))
def test_plan_places_every_piece_once(case):
    rng = np.random.default_rng(case)
    size = [64, 96, 1024, 12, 100][case]
    counts = rng.integers(0, [5, 40, 9, 100, 3][case], size)
    taken, fill = [np.zeros(c, int) for c in counts], {}
    for n, a, b, sequence, offset in packing.plan(counts):
        taken[n - 1][a:b] += 1
        for i in range(b - a):
            fill.setdefault(sequence + i, []).append((offset, n))
    assert all((t == 1).all() for t in taken)
    for parts in fill.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= size
    assert len(fill) <= 1.02 * best_fit(counts) + 1


def best_fit(counts):
    """Sequences that best fit on descending lengths takes, piece by piece."""
    rooms, used = [], 0
    for n in range(len(counts), 0, -1):
        for _ in range(counts[n - 1]):
            at = bisect.bisect_left(rooms, n)
            room = rooms.pop(at) if at < len(rooms) else len(counts)
            used += room == len(counts)
            bisect.insort(rooms, room - n)
    return used


def test_fit_is_non_negative_and_optimal():
    parts = packing.patterns(12)
    counts = np.random.default_rng(3).integers(0, 50, 12).astype(float)
    x = packing.fit(counts, parts)
    a = np.zeros((12, len(parts)))
    for j, p in enumerate(parts):
        for b in p:
            a[b - 1, j] += 1
    weights = (np.arange(1, 13) / 12) ** (2 * packing.WEIGHT)
    slope = a.T @ (weights * (counts - a @ x))
    assert (x >= 0).all() and slope.max() < 1e-6 and abs(slope[x > 1e-9]).max(initial=0) < 1e-6


def test_cuts():
    assert [packing.cuts(n, 4) for n in (1, 4, 5, 8, 9)] == [[0, 1], [0, 4], [0, 1, 5], [0, 4, 8], [0, 1, 5, 9]]


def check_packed(texts, got, length):
    """Every row of ``texts`` (id, text) has its pieces, and sequences are gapless."""
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        cut = packing.cuts(len(ids), length)
        for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    fill = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= length
    return len(fill)


def test_packed_pieces(spark, docs, empty):
    odd = spark.createDataFrame([(900 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    own = docs.select("doc_id", "text").unionByName(odd).cache()
    check_packed(own.collect(), packing.packed_pieces(queries.byte_pieces(own), 1024).collect(), 1024)
    assert packing.packed_pieces(queries.byte_pieces(empty), 1024).collect() == []


def test_pieces_of_long_white_space(spark):
    run = 1_200_000
    texts = [" " * run + "a", "\n" * run + "a", "b" + " " * run + "<|endoftext|>c", "d\t" + " " * (packing.LONG_RUN - 2) + "e", "f"]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_packed(list(enumerate(texts)), packing.packed_pieces(queries.byte_pieces(own).cache(), 1024).collect(), 1024)


def test_packing_of_given_documents(spark):
    texts = rows_of(spark, "documents", "doc_id", "text")
    got = entry.queries()["op10_pattern_packing"](spark, SF).collect()
    used = check_packed(texts, got, 1024)
    assert used <= 1.05 * -(-sum(r["length"] for r in got) // 1024)


def test_labels_without_documents_take_no_room(spark, monkeypatch):
    """Ten times more labels than documents, and a bound that has room for all labelled rows."""
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(-600, 60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "FIT_ROWS", 60)
    monkeypatch.setattr(quality, "fitted", lambda texts, y: seen.append((list(texts), y)))
    quality.trained(docs, labels)
    kept = {i for i in range(60) if zlib.crc32(str(i).encode()) % 5}
    assert len(seen[0][0]) == len(kept)
    assert {w for words, _ in seen[0][0] for w in words if w.startswith("other")} == {f"other{i}" for i in kept}


def test_long_texts_are_learnt_from(spark, monkeypatch):
    long_ = " ".join(["long", "text"] * 400_000)
    docs = spark.createDataFrame([(1, long_), (2, "a b a"), (3, None), (6, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 6)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fold", lambda key: F.lit(1))
    monkeypatch.setattr(quality, "fitted", lambda texts, y: seen.append(sorted(zip(texts, y, strict=True), key=str)))
    quality.trained(docs, labels)
    assert [dict(zip(*t, strict=True)) for t, _ in seen[0] if "long" in t[0]] == [{"long": 400_000, "text": 400_000}]
    assert len(seen[0]) == 4
