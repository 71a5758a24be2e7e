"""Stateful scan of text that arrives in chunks.

Sequences share a state by the hash of their number, ``buckets`` in all, as each call of a stateful function costs far more than
the few rows of one sequence. The state holds of each sequence: the number of the chunk expected next, the characters consumed,
the last few characters (as many as a bounded match can need), the patterns with an unbounded middle part that are open, and
chunks that came early. Nothing in it grows with the text consumed.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import patterns as P

ALERT = "seq_id BIGINT, pattern STRING, end BIGINT, chunk_no INT"
STATE = "sequences STRING"
BUCKETS = 4096


def first_completions(chunks: DataFrame, patterns=P.PII, buckets: int = BUCKETS) -> DataFrame:
    """(seq_id, pattern, end, chunk_no), once per sequence, at the first completed violation.

    ``chunks`` has seq_id, chunk_no (dense from 0) and piece; rows may come in any order. With a
    boolean column ``is_last`` the state of a sequence is removed after its last chunk. A query is
    restarted with the ``buckets`` that it was begun with; more of them make smaller states.
    """
    if "is_last" not in chunks.columns:
        chunks = chunks.withColumn("is_last", F.lit(False))
    # A NULL number has a bucket of its own: among others it would make floats of them.
    bucket = F.when(F.col("seq_id").isNotNull(), F.pmod(F.xxhash64("seq_id"), F.lit(buckets)))
    return (
        chunks.select(bucket.alias("bucket"), "seq_id", "chunk_no", "piece", F.coalesce("is_last", F.lit(False)).alias("is_last"))
        .filter(F.col("chunk_no").isNotNull())
        .groupBy("bucket")
        .applyInPandasWithState(_scanner(tuple(patterns)), ALERT, STATE, "append", GroupStateTimeout.NoTimeout)
    )


class _Sequence:
    """What is held of one sequence."""

    __slots__ = ("next_chunk", "consumed", "tail", "opened", "done", "early", "finished")

    def __init__(self, next_chunk=0, consumed=0, tail="", opened=(), done=False, early=()):
        self.next_chunk, self.consumed, self.tail, self.opened, self.done = next_chunk, consumed, tail, set(opened), done
        self.early, self.finished = {n: (piece, last) for n, piece, last in early}, False

    def stored(self) -> list:
        early = [(n, piece, last) for n, (piece, last) in self.early.items()]
        return [self.next_chunk, self.consumed, self.tail, sorted(self.opened), self.done, early]

    def arrived(self) -> list[str]:
        """The chunks that are next, in their order."""
        pieces, early, n = [], self.early, self.next_chunk
        while n in early:
            piece, last = early.pop(n)
            pieces.append(piece)
            self.finished = self.finished or last
            n += 1
        self.next_chunk = n
        return pieces

    def advance(self, patterns, keep: int) -> tuple[str, int, int] | None:
        """Consume what is next; the first completion in it as (pattern, end, chunk_no)."""
        first, pieces = self.next_chunk, self.arrived()
        if self.done or not pieces:
            return None
        hit, self.tail, self.opened = _advance(patterns, keep, self.tail, "".join(pieces), self.opened)
        ends = list(accumulate(map(len, pieces)))
        before, self.consumed = self.consumed, self.consumed + ends[-1]
        if not hit:
            return None
        name, end = hit
        self.done, self.tail, self.opened = True, "", set()
        self.early = {n: ("", last) for n, (_, last) in self.early.items()}
        return name, before + end, first + bisect_left(ends, end)


def _scanner(patterns: tuple[P.Pattern, ...]):
    keep = max(p.reach for p in patterns)

    def scan(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {seq_id: _Sequence(*rest) for seq_id, *rest in (json.loads(state.get[0]) if state.exists else ())}
        alerts = []
        for frame in frames:
            came = set()
            ids = [None] * len(frame) if key[0] is None else frame["seq_id"].tolist()
            for seq_id, n, piece, last in zip(ids, frame["chunk_no"].tolist(), frame["piece"].tolist(), frame["is_last"].tolist()):
                sequence = held.get(seq_id)
                if sequence is None:
                    sequence = held[seq_id] = _Sequence()
                if n >= sequence.next_chunk:
                    sequence.early[n] = ("" if sequence.done else piece, last)
                    came.add(seq_id)
            for seq_id in came:
                hit = held[seq_id].advance(patterns, keep)
                if hit:
                    alerts.append((seq_id, *hit))
        left = [[seq_id, *sequence.stored()] for seq_id, sequence in held.items() if not sequence.finished]
        if left:
            state.update((json.dumps(left),))
        elif state.exists:
            state.remove()
        if alerts:
            yield pd.DataFrame(alerts, columns=["seq_id", "pattern", "end", "chunk_no"])

    return scan


def _advance(patterns, keep: int, tail: str, piece: str, opened: set[str]):
    """The first completion inside ``piece``, if any, as (pattern, characters into the piece), then
    the tail and the open patterns behind it."""
    text, halo = tail + piece, len(tail)
    ends, still_open = [], set()
    # A hint that several patterns share is looked for once.
    hinted = {hint: re.search(hint, text) for hint in {p.hint for p in patterns if p.hint}}
    for rank, p in enumerate(patterns):
        found = re.search(p.completing, text) if hinted.get(p.hint, True) else None
        if found:
            ends.append((found.end() - halo, rank))
        if p.opened:
            if p.name in opened:
                closed = re.match(p.closing, text)
                if closed and closed.end() > halo:
                    ends.append((closed.end() - halo, rank))
            if re.search(p.opened, text) or (p.name in opened and re.match(p.filler, piece)):
                still_open.add(p.name)
    hit = None
    if ends:
        end, rank = min(ends)
        hit = (patterns[rank].name, end)
    return hit, text[max(0, len(text) - keep) :], still_open
