"""Alignment of two tokenizers over a corpus, with the counts of linked id pairs by minimal perfect hashing.

Both tokenizers read a space and the text: A is a byte-level BPE, B a piece model that adds the space itself. Byte offsets
where tokens of both end cut the text into groups; an A and a B token whose byte ranges end together are linked. As no token is
empty, each group has exactly one link, that of its last tokens.

1. A first pass aligns all documents; every task sums up its links by id pair and writes the sums.
2. The distinct pairs go to the driver, which gives each a slot by a minimal perfect hash. They are few, whatever the
   corpus: of two linked tokens one ends with the bytes of the other, so ``linkable`` counts the possible pairs from the vocabularies alone
   (0.6 million for those of the query), and more are refused.
3. The written sums become dense vectors of counts by slot, cut into blocks and summed up in a tree (``FAN`` vectors at a time).
   Each slot's key is checked against the pair that is looked up.
4. A second pass aligns the documents again and looks the counts up.

Tokens never cross from a non-space character to a white-space one, so a text is a list of chunks (white space, then other characters), and
a worker keeps what it knows of the chunks it has met, ``CACHE_ROWS`` at most. Where that does not hold for a text (it has a
character that some piece of B joins to others, or a chunk that B changes), the text is encoded whole; ``Tokenizers`` finds these characters in the vocabulary of B.

Null and empty texts, and texts that the joined bytes of B's tokens do not give back, have no tokens: zeros, and an empty string
for the digest; they add to no count. Repeated rows count each time. The chunks of one text are in a worker's memory at once.
"""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

# The characters that are white space in Unicode.
WHITE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACE = "▁"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
# White-space runs from which on the pattern engine of tiktoken is not relied on.
LONG_RUN = 100_000
CACHE_ROWS = 300_000
# Longer chunks are aligned anew each time.
LONGEST_KEPT = 64
# Bytes of text that are taken at once.
AT_ONCE = 2_000_000
BLOCK = 4096
FAN = 16


class Tokenizers:
    """A and B, and the bytes of their tokens.

    ``ranks`` and ``tokenizer`` are one byte-level vocabulary, as ranks and as a file of the ``tokenizers`` library; ``pieces`` is a model of
    ``sentencepiece``.
    """

    def __init__(self, ranks: str, tokenizer: str, pattern: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._a = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=of, special_tokens={})
        self._file = tokenizer
        self._b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes = {i: b for b, i in of.items()}
        self.b_bytes = {}
        names = [self._b.id_to_piece(i) for i in range(self._b.vocab_size())]
        for i, name in enumerate(names):
            self.b_bytes[i] = bytes([int(name[3:5], 16)]) if self._b.is_byte(i) else name.replace(SPACE, " ").encode()
        self.a_size = {i: len(b) for i, b in self.a_bytes.items()}
        self.b_size = {i: len(b) for i, b in self.b_bytes.items()}
        self.sizes_a, self.sizes_b = (np.array([x.get(i, 0) for i in range(max(x) + 1)]) for x in (self.a_size, self.b_size))
        # Every id as it is written in a group: inside, and as the last of its side.
        n, m = len(self.sizes_a), len(self.sizes_b)
        self.written = [f"{i}{sign}" for count, signs in ((n, ",|"), (m, ",;")) for sign in signs for i in range(count)]
        self.written_at = (0, n), (2 * n, 2 * n + m)
        self._lone = self._b.piece_to_id(SPACE)
        # White space inside pieces, and a literal sign for the space, may join what chunks keep apart.
        odd = {c for n in names for c in n if c in WHITE} | {SPACE}
        self.joining = re.compile(f"[{re.escape(''.join(sorted(odd)))}]")
        self.joins_all = any(re.search(f"[^{SPACE}]{SPACE}", n) for n in names)

    def encode_a(self, text: str) -> list[int]:
        if len(text) >= LONG_RUN and re.search(rf"\s{{{LONG_RUN}}}", text):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(self._file)
            library.encode_special_tokens = True
            return library.encode(text, add_special_tokens=False).ids
        return self._a.encode_ordinary(text)

    def encode_chunks(self, chunks: list[str], ends: np.ndarray) -> np.ndarray:
        """A's ids of chunks that end at the byte offsets ``ends``. No token of A goes on from one into the next, as its pattern never joins
        white space to what is before it, so they are encoded as one text."""
        ids = np.array(self.encode_a("".join(chunks)), dtype=np.int64)
        if not np.isin(ends, np.cumsum(self.sizes_a[ids])).all():
            raise ValueError("a token crosses the border of chunks")
        return ids

    def whole(self, text: str) -> tuple[list[int], list[int]] | None:
        """The ids of a text, or None where B does not give its bytes back."""
        b = self._b.encode(text)
        full = " " + text
        if b"".join(map(self.b_bytes.__getitem__, b)) != full.encode():
            return None
        return self.encode_a(full), b

    def b_of_chunks(self, chunks: list[str]) -> list[list[int]]:
        """B's ids of each chunk as part of a text; where they can't be had alone they don't give the chunk's bytes."""
        spaced = [c[0] == " " and len(c) > 1 for c in chunks]
        encoded = self._b.encode([c[1:] if s else c for c, s in zip(chunks, spaced, strict=True)], num_threads=1)
        # Without the space that B adds.
        return [b if s else b[1:] if b and b[0] == self._lone else [] for s, b in zip(spaced, encoded, strict=True)]


def linkable(a_bytes: dict[int, bytes], b_bytes: dict[int, bytes]) -> int:
    """How many id pairs can be linked: one token's bytes end with the other's."""
    of_a, of_b = Counter(a_bytes.values()), Counter(b_bytes.values())
    longer_b = sum(n * of_a[t[k:]] for t, n in of_b.items() for k in range(len(t)))
    return longer_b + sum(n * of_b[t[k:]] for t, n in of_a.items() for k in range(1, len(t)))


def groups(a: list[int], b: list[int], a_size: dict[int, int], b_size: dict[int, int]) -> tuple[str, list[int]]:
    """The groups as text, and the linked pairs as a << 32 | b."""
    parts, links = [], []
    i = j = end_a = end_b = from_a = from_b = 0
    while i < len(a):
        end_a += a_size[a[i]]
        i += 1
        while end_b < end_a:
            end_b += b_size[b[j]]
            j += 1
        if end_a == end_b:
            parts.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
            links.append(a[i - 1] << 32 | b[j - 1])
            from_a, from_b = i, j
    return ";".join(parts), links


class PerfectHash:
    """A slot from 0 to n - 1 for each of n distinct keys: levels of bits, a bit set where one key alone falls; keys that met
    others go to the next level. A slot is the rank of its bit."""

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        left = np.asarray(keys, dtype=np.uint64)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        base = 0
        while len(left):
            size = max(64, int(len(left) * room))
            at = self._hash(left, len(self.levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            bits = np.packbits(np.r_[alone, np.zeros(-size % 64, bool)], bitorder="little").view("<u8")
            rank = base + np.r_[0, np.cumsum(np.bitwise_count(bits), dtype=np.int64)]
            self.levels.append((size, bits, rank[:-1]))
            base = int(rank[-1])
            left = left[~alone[at.astype(np.int64)]]
        self.keys = np.zeros(base, dtype=np.uint64)
        own = np.asarray(keys, dtype=np.uint64)
        self.keys[self._slots(own)] = own

    @staticmethod
    def _hash(keys: np.ndarray, level: int) -> np.ndarray:
        x = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, (size, bits, rank) in enumerate(self.levels):
            at = self._hash(keys[open_], level) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = (bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            slots[open_[here]] = (rank[word] + below)[here]
            open_ = open_[~here]
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The keys' slots; a key that has none is an error."""
        keys = np.asarray(keys, dtype=np.uint64)
        found = self._slots(keys)
        if len(keys) and (found.min() < 0 or (self.keys[found] != keys).any()):
            raise KeyError("a pair without a slot")
        return found


class Known:
    """What a worker knows of chunks, by row: tokens of A and B, links (all in one list), groups as text that ends in a semicolon; ``fails`` if a chunk can't be had alone."""

    def __init__(self, tokenizers: Tokenizers, with_text: bool = True):
        self.tokenizers, self.with_text = tokenizers, with_text
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.text: list[str] = []
        self.n_a = self.n_b = self.n_links = np.zeros(0, dtype=np.int64)
        self.fails = np.zeros(0, dtype=bool)
        self.links = np.zeros(0, dtype=np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Chunks that begin with white space and end without are aligned together, as one text; others fail."""
        t = self.tokenizers
        raw = [c.encode() for c in chunks]
        ids_b = t.b_of_chunks(chunks)
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        sizes_b = np.array([sum(map(t.b_size.__getitem__, b)) for b in ids_b], dtype=np.int64)
        whole = np.array_equal(sizes, sizes_b) and b"".join(raw) == b"".join(t.b_bytes[i] for b in ids_b for i in b)
        good = np.array([
            c[0] in WHITE and c[-1] not in WHITE and (whole or r == b"".join(map(t.b_bytes.__getitem__, b))) for c, r, b in zip(chunks, raw, ids_b, strict=True)
        ], dtype=bool)
        sizes = np.where(good, sizes, 0)
        n_b = np.where(good, [len(b) for b in ids_b], 0)
        b = np.array([i for ok, b in zip(good, ids_b, strict=True) if ok for i in b], dtype=np.int64)
        ends = np.cumsum(sizes)
        a = t.encode_chunks([c for c, ok in zip(chunks, good, strict=True) if ok], ends[good]) if good.any() else np.zeros(0, dtype=np.int64)
        end_a, end_b = np.cumsum(t.sizes_a[a]), np.cumsum(t.sizes_b[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        last_a, last_b = cuts[group_a] == end_a, cuts[group_b] == end_b
        n_a = np.diff(np.r_[0, np.searchsorted(end_a, ends, "right")])
        n_links = np.diff(np.r_[0, np.searchsorted(cuts, ends, "right")])
        first = len(self.text)
        self.row.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        if self.with_text:
            (in_a, end_of_a), (in_b, end_of_b) = t.written_at
            sign = np.r_[a + np.where(last_a, end_of_a, in_a), b + np.where(last_b, end_of_b, in_b)]
            order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
            pieces = list(map(t.written.__getitem__, sign[order].tolist()))
            at = np.r_[0, np.cumsum(n_a + n_b)].tolist()
            self.text += ["".join(pieces[x:y]) for x, y in pairwise(at)]
        else:
            self.text += [""] * len(chunks)
        self.n_a, self.n_b, self.n_links = np.r_[self.n_a, n_a], np.r_[self.n_b, n_b], np.r_[self.n_links, n_links]
        self.fails, self.links = np.r_[self.fails, ~good], np.r_[self.links, a[last_a] << 32 | b[last_b]]

    def documents(self, texts: list[str]) -> list[np.ndarray | tuple[list[int], list[int]] | None]:
        """For each text the rows of its chunks, or its ids where it was encoded whole, or None if it has no tokens."""
        whole = [not t or self.tokenizers.joins_all or bool(self.tokenizers.joining.search(t)) for t in texts]
        split = [[] if w else CHUNK.findall(" " + t) for t, w in zip(texts, whole, strict=True)]
        missing = list(set().union(*split).difference(self.row)) if split else []
        for k in range(0, len(missing), 20_000):
            self.learn(missing[k : k + 20_000])
        out = []
        for t, w, chunks in zip(texts, whole, split, strict=True):
            rows = np.fromiter(map(self.row.__getitem__, chunks), dtype=np.int64, count=len(chunks))
            if w or self.fails[rows].any():
                out.append(self.tokenizers.whole(t) if t else None)
            else:
                out.append(rows)
        return out

    def full(self) -> bool:
        return len(self.row) > CACHE_ROWS

    def forget_long(self) -> None:
        """Rows of long chunks stay until the next ``clear``, but nothing finds them."""
        for c in [c for c in self.row if len(c) > LONGEST_KEPT]:
            del self.row[c]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches, each of about AT_ONCE bytes of text or one row, with the texts in the last column."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        sizes = [s or 0 for s in pc.binary_length(texts.cast(pa.binary())).to_pylist()]
        start, size = 0, 0
        for i, s in enumerate([*sizes, AT_ONCE + 1]):
            if i > start and size + s > AT_ONCE:
                yield batch.slice(start, i - start), [t or "" for t in texts.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += s


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(own), dtype=np.int64)
    np.add.at(total, at, counts)
    return own, total


def pair_sums(docs: DataFrame, files: tuple[str, str, str, str], text: str = "text") -> DataFrame:
    """``pair`` (A id << 32 | B id) and ``n``, how many links of a task's documents it has."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(Tokenizers(*files), with_text=False)
        a_size, b_size = known.tokenizers.a_size, known.tokenizers.b_size
        keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        often = np.zeros(0, dtype=np.int64)
        for _, texts in _slices(batches):
            whole: list[int] = []
            rows = [np.zeros(0, dtype=np.int64)]
            for found in known.documents(texts):
                if isinstance(found, np.ndarray):
                    rows.append(found)
                elif found:
                    whole += groups(*found, a_size, b_size)[1]
            new = np.bincount(np.concatenate(rows), minlength=len(known.text))
            new[: len(often)] += often
            often = new
            if whole:
                keys, sums = _summed(np.r_[keys, np.int64(whole)], np.r_[sums, np.ones(len(whole), dtype=np.int64)])
            known.forget_long()
            if known.full():
                keys, sums = _summed(np.r_[keys, known.links], np.r_[sums, np.repeat(often, known.n_links)])
                known.clear()
                often = np.zeros(0, dtype=np.int64)
        keys, sums = _summed(np.r_[keys, known.links], np.r_[sums, np.repeat(often, known.n_links)])
        used = sums > 0
        yield pa.RecordBatch.from_arrays([pa.array(keys[used]), pa.array(sums[used])], names=["pair", "n"])

    return docs.select(F.col(f"`{text}`").alias("_text")).mapInArrow(align, "pair long, n long")


def dense_counts(sums: DataFrame, hashed: PerfectHash) -> np.ndarray:
    """The sum of ``n`` by slot: a vector of each task of ``sums``, in blocks, summed up in a tree."""
    shared = sums.sparkSession.sparkContext.broadcast(hashed)
    size = len(hashed.keys)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-max(size, 1) // BLOCK) * BLOCK, dtype=np.int64)
        for batch in batches:
            np.add.at(total, shared.value.slots(batch.column(0).to_numpy().astype(np.uint64)), batch.column(1).to_numpy())
        blocks = total.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(blocks[used]), pa.list_(pa.int64()))], names=["block", "counts"])

    def add(group: pa.Table) -> pa.Table:
        counts = np.stack(group.column("counts").to_numpy()).sum(axis=0)
        return pa.Table.from_arrays([group.column("part").slice(0, 1), group.column("block").slice(0, 1), pa.array([counts], pa.list_(pa.int64()))], names=["part", "block", "counts"])

    parts = sums.rdd.getNumPartitions()
    tree = sums.select("pair", "n").mapInArrow(vectors, "block int, counts array<long>").withColumn("part", F.spark_partition_id())
    tree = tree.select("part", "block", "counts")
    while True:
        # FAN vectors at most meet in a task, a block at a time.
        parts = -(-parts // FAN)
        tree = tree.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        tree = tree.groupBy("part", "block").applyInArrow(add, "part int, block int, counts array<long>")
        if parts <= 1:
            break
    total = np.zeros(-(-max(size, 1) // BLOCK) * BLOCK, dtype=np.int64)
    for row in tree.collect():  # as many numbers as there are pairs
        total[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = row["counts"]
    return total[:size]


def aligned(docs: DataFrame, ranks: str, tokenizer: str, pattern: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ``key`` of every row, ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links``, ``n_best`` (links whose pair's count is the highest of its B id),
    ``count_sum`` (the pairs' counts over the links) and ``groups_sha256``.

    The paths are files that every worker can read.
    """
    spark = docs.sparkSession
    files = (ranks, tokenizer, pattern, pieces)
    sums = written(pair_sums(docs, files, text), "pairs")
    own = Tokenizers(*files)
    most = linkable(own.a_bytes, own.b_bytes)
    distinct = sums.select("pair").distinct().limit(most + 1).toArrow()
    if distinct.num_rows > most:
        raise ValueError("more pairs than the vocabularies can link")
    hashed = PerfectHash(np.sort(distinct.column(0).to_numpy()).astype(np.uint64))
    counts = dense_counts(sums, hashed)
    b_ids = (hashed.keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    highest = np.zeros(max(own.b_size) + 1, dtype=np.int64)
    np.maximum.at(highest, b_ids, counts)
    shared = spark.sparkContext.broadcast((hashed, counts, (counts == highest[b_ids]).astype(np.int64)))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, count, best = shared.value
        known = Known(Tokenizers(*files))
        a_size, b_size = known.tokenizers.a_size, known.tokenizers.b_size
        by_row = np.zeros((2, 0), dtype=np.int64)
        done = 0
        for batch, texts in _slices(batches):
            found = known.documents(texts)
            # Sums over the links of the chunks that are new.
            fresh = known.n_links[by_row.shape[1] :]
            at = slots.slots(known.links[done:])
            done = len(known.links)
            ends = np.cumsum(fresh)
            by_row = np.concatenate([by_row, [np.diff(np.r_[0, np.r_[0, np.cumsum(x[at])][ends]]) for x in (best, count)]], axis=1)
            values = np.zeros((len(names), len(texts)), dtype=np.int64)
            digests = []
            for i, rows in enumerate(found):
                if rows is None:
                    digests.append("")
                    continue
                if isinstance(rows, np.ndarray):
                    n_links = known.n_links[rows].sum()
                    values[:, i] = known.n_a[rows].sum(), known.n_b[rows].sum(), n_links, n_links, *by_row[:, rows].sum(axis=1)
                    # A chunk's tokens end with it, so its groups are groups of the text.
                    own_text = "".join(map(known.text.__getitem__, rows.tolist()))[:-1]
                else:
                    own_text, links = groups(*rows, a_size, b_size)
                    at = slots.slots(np.array(links, dtype=np.int64))
                    values[:, i] = len(rows[0]), len(rows[1]), len(links), len(links), best[at].sum(), count[at].sum()
                digests.append(sha256(own_text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(v) for v in values), pa.array(digests, pa.string())], names=[batch.schema.names[0], *names, "groups_sha256"]
            )
            known.forget_long()
            if known.full():
                known.clear()
                by_row, done = np.zeros((2, 0), dtype=np.int64), 0

    table = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text"))
    kind = table.schema.fields[0].dataType.simpleString()
    return table.mapInArrow(look_up, f"`{key}` {kind}, {', '.join(f'{n} long' for n in names)}, groups_sha256 string")
