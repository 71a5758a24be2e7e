"""Alignment of two tokenizers against whole-text encoding by the libraries, and the perfect hash."""

import bisect
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import SF
from tokenizers import Tokenizer

from fenceline.llm import alignment, queries

FILES = (P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Plain:
    """Offsets of whole texts, without chunks, hashes or caches."""

    def __init__(self):
        self.a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        # Byte-level signs: printable bytes stand for themselves, the others follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}

    def tokens(self, text):
        if not text:
            return None
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        full = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == full == b"".join(x for _, x in b) else None

    def ends(self, tokens):
        at, out = 0, []
        for i, x in tokens:
            at += len(x)
            out.append((at, i))
        return out

    def rows(self, texts):
        parts = []
        for t in texts:
            if not (found := self.tokens(t)):
                parts.append(None)
                continue
            a, b = self.ends(found[0]), self.ends(found[1])
            cuts = sorted({x for x, _ in a} & {x for x, _ in b})
            last_a, last_b = dict(a), dict(b)  # no token is empty
            links = [(last_a[x], last_b[x]) for x in cuts]
            sides = []
            for tokens in (a, b):
                own = [[] for _ in cuts]
                for x, i in tokens:
                    own[bisect.bisect_left(cuts, x)].append(str(i))
                sides.append(own)
            text = [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides, strict=True)]
            parts.append((len(a), len(b), len(cuts), links, ";".join(text)))
        counts = Counter(link for p in parts if p for link in p[3])
        best = {}
        for (_, j), n in counts.items():
            best[j] = max(best.get(j, 0), n)
        for p in parts:
            if p is None:
                yield (0, 0, 0, 0, 0, 0, "")
            else:
                n_best = sum(counts[x] == best[x[1]] for x in p[3])
                yield (*p[:3], len(p[3]), n_best, sum(counts[x] for x in p[3]), sha256(p[4].encode()).hexdigest())


AWKWARD = [
    "", None, " ", "\n", "a", " a", "a ", "a  b   c", "a\n\nb\n  c\t d\t\te", "x;\r\ny {\r\n}", "▁a ▁", "<|endoftext|> <s> </s> <unk> <0x41>", "it's they'll 'twas ' s",
    " a  b c　d", "a\x1cb \x1c c\x85d", "ﬁ ² é ẛ̣", "日本語のテキスト 漢字", "🙂🙂 a🙂b", "\x00a\x00 b", "zz" * 700, "word " * 50 + "\n" * 40, "﻿bom", "end. \n", "0123 4567.89", "̈a ̈b",
]

texts_ = st.text(st.sampled_from(list("ab'sZ0.,é漢🙂 \n\t\r ▁　\x1c")), max_size=24)


def encoded(texts, tokenizers, plain):
    known = alignment.Known(tokenizers)
    for t, found in zip(texts, known.documents([t or "" for t in texts]), strict=True):
        expected = plain.tokens(t)
        if found is None:
            assert expected is None, t
            continue
        if isinstance(found, np.ndarray):
            got = (int(known.n_a[found].sum()), int(known.n_b[found].sum()), "".join(known.text[r] for r in found)[:-1])
        else:
            got = (len(found[0]), len(found[1]), alignment.groups(*found, tokenizers.a_size, tokenizers.b_size)[0])
        assert expected is not None, t
        a, b = [i for i, _ in expected[0]], [i for i, _ in expected[1]]
        assert got == (len(a), len(b), alignment.groups(a, b, tokenizers.a_size, tokenizers.b_size)[0]), t


PLAIN, OWN = Plain(), alignment.Tokenizers(*FILES)


@settings(max_examples=400, deadline=None)
@given(st.lists(texts_, max_size=5))
def test_chunks_are_as_good_as_whole_texts(texts):
    encoded(texts, OWN, PLAIN)


def test_awkward_texts_by_chunks():
    encoded(AWKWARD, OWN, PLAIN)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 63) - 1), max_size=500))
def test_perfect_hash(keys):
    own = np.array(sorted(keys), dtype=np.uint64)
    hashed = alignment.PerfectHash(own)
    assert sorted(hashed.slots(own).tolist()) == list(range(len(own)))
    for other in (1 << 63, (1 << 63) + 12345):
        try:
            hashed.slots(np.array([other], dtype=np.uint64))
            raise AssertionError("a key without a slot was found")
        except KeyError:
            pass


def test_pairs_have_a_bound():
    tokens = {0: b"a", 1: b"ba", 2: b"c"}, {0: b"a", 5: b"cba", 7: b"c", 8: b"x"}
    pairs = {(i, j) for i, x in tokens[0].items() for j, y in tokens[1].items() if x.endswith(y) or y.endswith(x)}
    assert alignment.linkable(*tokens) == len(pairs)
    assert alignment.linkable(OWN.a_bytes, OWN.b_bytes) < 1_000_000


def test_rows(spark, docs, empty, monkeypatch):
    own = docs.select("doc_id", "text", "row").unionByName(spark.createDataFrame([(500 + i, t, "n_a") for i, t in enumerate(AWKWARD)], "doc_id long, text string, `row` string"))
    rows = own.select("doc_id", "text").collect()
    expected = Counter((r["doc_id"], *x) for r, x in zip(rows, PLAIN.rows([r["text"] for r in rows]), strict=True))
    got = alignment.aligned(own.repartition(7), *FILES).select("doc_id", *COLUMNS).collect()
    assert Counter(map(tuple, got)) == expected
    assert alignment.aligned(empty, *FILES).count() == 0
    # Several levels of the tree.
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "BLOCK", 64)
    again = alignment.aligned(own.repartition(7), *FILES).select("doc_id", *COLUMNS).collect()
    assert Counter(map(tuple, again)) == expected


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = Counter((r["doc_id"], *x) for r, x in zip(rows, PLAIN.rows([r["text"] for r in rows]), strict=True))
    assert Counter(map(tuple, queries.op12_pair_alignment(spark, SF).select("doc_id", *COLUMNS).collect())) == expected
