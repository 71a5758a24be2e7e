"""Packing of token sequences by patterns: non-negative least squares on the histogram of lengths.

1. ``pieces`` encodes every text, ends it with an id and cuts what is longer than a sequence: all
   pieces but the first have the full length.
2. The histogram of the pieces' lengths (as many counts as a sequence has tokens) goes to the driver.
   ``plan`` bins it, enumerates the patterns of one to ``PARTS`` bins that fill a sequence
   exactly, fits non-negative repeat counts to the binned histogram, rounds them down, and packs what is left by
   best fit, whole counts at a time. Its work depends on the sequence length alone.
3. The plan's rows say: the pieces of this length with ranks from a to b go to sequences s, s + 1, ...
   at this offset. ``packed_pieces`` ranks the pieces within their length and joins the plan.

A null text is empty: its document is the end id alone. Repeated rows, also of one ``doc_id``, are
packed one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless

PARTS = 3
# White-space runs from which on the pattern engine of tiktoken is not relied on; it fails at about a million.
LONG_RUN = 100_000
# Tokens in a bin of the fit, at the default length of a sequence.
BINS = 256
WEIGHT = 4.0


def _encoding(path: str, pattern: str, specials: dict[str, int]):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cuts(n: int, length: int) -> list[int]:
    """The borders of the pieces of a document of ``n`` ids."""
    return [0, *range(n % length or length, n + 1, length)] if n else [0]


def pieces(docs: DataFrame, ranks: str, tokenizer: str, pattern: str, specials: dict[str, int], end_id: int, length: int, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """``keep``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of each piece of each text.

    ``ranks`` and ``tokenizer`` are the paths of one byte-level vocabulary, as ranks and as a file of the ``tokenizers`` library,
    that every worker can read; ``specials`` are strings with an id of their own, in both. Texts with a run of LONG_RUN white-space
    characters are encoded by ``tokenizers``, all others by ``tiktoken``, which gives the same ids faster.
    """
    long_run = re.compile(rf"\s{{{LONG_RUN}}}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks, pattern, specials)
        library = None
        for batch in batches:
            rows, piece, start, size, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                t = t.as_py() or ""
                if len(t) >= LONG_RUN and long_run.search(t):
                    library = library or _tokenizer(tokenizer)
                    ids = library.encode(t, add_special_tokens=False).ids
                elif any(s in t for s in specials):
                    ids = encoding.encode(t, allowed_special="all")
                else:
                    ids = encoding.encode_ordinary(t)
                ids.append(end_id)
                data = memoryview(np.array(ids, dtype="<u4").tobytes())
                for k, (a, b) in enumerate(pairwise(cuts(len(ids), length))):
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))],
                names=[batch.schema.names[0], "piece", "start", "length", "ids_crc32"],
            )

    own = docs.select(F.col(f"`{keep}`"), F.col(f"`{text}`").alias("_text"))
    kind = own.schema.fields[0].dataType.simpleString()
    return own.mapInArrow(cut, f"`{keep}` {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(bins: int, parts: int = PARTS) -> list[tuple[int, ...]]:
    """All descending tuples of at most ``parts`` numbers that add up to ``bins``."""
    found, open_ = [], [((), bins)]
    while open_:
        head, left = open_.pop()
        top = min(left, head[-1] if head else bins)
        if 1 <= left <= top:
            found.append((*head, left))
        if len(head) + 1 < parts:
            # The largest first: the rest must fit into the parts that remain.
            open_ += [((*head, x), left - x) for x in range(-(-left // (parts - len(head))), min(top, left - 1) + 1)]
    return sorted(found, reverse=True)


def fit(counts: np.ndarray, parts: list[tuple[int, ...]], power: float = WEIGHT) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that minimise the squares of (their bins - ``counts``), where bin b
    weighs b to ``power``: long pieces are harder to place among what is left.

    The active-set method: the pattern with the steepest descent joins, the least-squares solution over
    the joined ones is taken, and steps stop where a count would turn negative, which then leaves.
    """
    bins = len(counts)
    a = np.zeros((bins, len(parts)))
    for j, p in enumerate(parts):
        for b in p:
            a[b - 1, j] += 1
    weights = (np.arange(1, bins + 1) / bins) ** power
    a, counts = a * weights[:, None], counts * weights
    x, joined = np.zeros(len(parts)), np.zeros(len(parts), bool)
    tolerance = 1e-9 * max(1.0, float(counts.max(initial=0)))
    for _ in range(3 * bins):
        w = a.T @ (counts - a @ x)
        w[joined] = -np.inf
        best = int(np.argmax(w))
        if w[best] <= tolerance:
            break
        joined[best] = True
        while True:
            at = np.flatnonzero(joined)
            s = np.linalg.lstsq(a[:, at], counts, rcond=None)[0]
            if (s > 0).all():
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            gone = at[low & (x[at] <= 1e-12 * max(1.0, counts.max()))]
            if not len(gone):
                gone = at[low][:1]
            x[gone], joined[gone] = 0.0, False
        x[~joined] = 0.0
    return x


def _runs(counts: np.ndarray, width: int) -> list[list[list[int]]]:
    """For each bin its lengths, longest first, as [length, next rank, rows left]."""
    bins = len(counts) // width
    return [[[n, 0, int(counts[n - 1])] for n in range(b * width, (b - 1) * width, -1) if counts[n - 1]] for b in range(1, bins + 1)]


def plan(counts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, offset) that place ``counts[n - 1]`` pieces of
    each length n into sequences of ``len(counts)`` tokens."""
    size = len(counts)
    width = next(w for w in range(max(1, size // BINS), size + 1) if size % w == 0)
    runs = _runs(counts, width)
    left = np.array([sum(r[2] for r in run) for run in runs], dtype=np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def take(run: list[list[int]], n: int) -> list[tuple[int, int, int]]:
        """The next ``n`` rows of a bin as (length, first rank, how many)."""
        taken = []
        while n:
            r = run[0]
            k = min(n, r[2])
            taken.append((r[0], r[1], k))
            r[1], r[2], n = r[1] + k, r[2] - k, n - k
            if not r[2]:
                run.pop(0)
        return taken

    def place(members: list[list[tuple[int, int, int]]]) -> None:
        """Members are lists of runs of equal total; cut them so that lengths are constant, and write rows."""
        nonlocal sequences
        members = [list(m) for m in members]
        while members[0]:
            k, offset = min(m[0][2] for m in members), 0
            for m in members:
                n, rank, have = m[0]
                rows.append((n, rank, rank + k, sequences, offset))
                offset += n
                if have == k:
                    m.pop(0)
                else:
                    m[0] = (n, rank + k, have - k)
            sequences += k

    every = patterns(size // width)
    repeats = np.floor(fit(left.astype(float), every) + 1e-6).astype(np.int64)
    for j in sorted(np.flatnonzero(repeats), key=lambda j: (-repeats[j], j)):
        parts = every[j]
        n = min(int(repeats[j]), *(int(left[b - 1]) // parts.count(b) for b in parts))
        if n:
            place([take(runs[b - 1], n) for b in parts])
            for b in parts:
                left[b - 1] -= n

    # What is left, by best fit: groups of equal sequences, by the room in them.
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, members: list[tuple[int, int]]) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((n, members))

    for run in reversed(runs):
        while run:
            n, rank, have = run[0]
            at = bisect_left(rooms, n)
            if at == len(rooms):
                # New sequences, each with as many pieces of this length as have room.
                each = size // n
                full, rest = divmod(have, each)
                if full:
                    put(size - each * n, full, [(n, rank + i * full) for i in range(each)])
                if rest:
                    put(size - rest * n, 1, [(n, rank + each * full + i) for i in range(rest)])
                run.pop(0)
                continue
            room = rooms[at]
            many, members = groups[room].pop()
            k = min(many, have)
            if many > k:
                groups[room].append((many - k, [(m, r + k) for m, r in members]))
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            put(room - n, k, [*members, (n, rank)])
            run[0] = [n, rank + k, have - k]
            if have == k:
                run.pop(0)
    for room in rooms:
        for many, members in groups[room]:
            place([[(n, rank, many)] for n, rank in members])
    return rows


def packed_pieces(pieces_: DataFrame, length: int, keep: str = "doc_id") -> DataFrame:
    """``pieces_`` with ``sequence_id`` and ``offset``. The input is read three times, so it should
    be a stored table."""
    spark = pieces_.sparkSession
    counts = np.zeros(length, dtype=np.int64)
    for r in pieces_.groupBy("length").count().collect():  # one row per length at most
        counts[r["length"] - 1] = r["count"]
    rows = plan(counts)
    schema = "length long, _from long, _to long, _sequence long, offset long"
    places = spark.createDataFrame(rows, schema)
    ranked = gapless(pieces_, ["length"], [keep, "piece", "ids_crc32"], "_rank", int(counts.sum()))
    return (
        # The plan's rows depend on the sequence length, not on the data.
        ranked.join(F.broadcast(places), "length")
        .where("_rank >= _from and _rank < _to")
        .withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_from"))
        .drop("_from", "_to", "_sequence", "_rank")
    )
