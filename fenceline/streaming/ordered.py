"""Chunks of sequences in their order, with early, late and lost ones.

Sequences share a state in the RocksDB state store by the hash of their number, ``buckets`` in all, and its timer is that of the sequence that is due
first: a call per sequence costs far more than its rows. Without buckets a sequence has a state of its own. A chunk that comes early waits
there, and a batch writes a state that it touches by one call. A chunk that does not come
until ``patience`` after the event time of the first one waiting behind it, by the watermark, is given up: the sequence goes on behind the gap and the
gap is reported. So is a gap behind which more than ``most_waiting`` chunks wait; nothing in the state grows without bound. What comes
for a gap that was given up is dropped. A sequence without news for ``idle`` gives up its state.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import patterns as P
from .chunks import BUCKETS, _advance

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CURSOR = "next_chunk INT, consumed BIGINT, carry STRING, waiting INT, timer BIGINT, finished BOOLEAN, gaps BOOLEAN"
EARLY = "chunk_no INT, piece STRING, is_last BOOLEAN, sent BIGINT"
SHARED = "sequences STRING, timer BIGINT"
# The bucket of the NULL number.
NO_NUMBER = -1


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which keyed maps and timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


@dataclass(frozen=True)
class Patience:
    """Milliseconds of event time."""

    gap: int = 600_000
    idle: int = 86_400_000
    most_waiting: int = 10_000


class Ordered(StatefulProcessor):
    """Feeds the chunks of a sequence to ``take`` in order, those that follow one another at once, and gaps to ``skip``; both return output rows and what to carry on. What it
    holds is that of one sequence."""

    columns: list[str]
    fresh: dict

    def __init__(self, patience: Patience):
        self.patience = patience

    def take(self, key, first: int, consumed: int, pieces: list[str], carry: dict) -> tuple[list[tuple], dict]:
        raise NotImplementedError

    def skip(self, key, first: int, last: int, carry: dict) -> tuple[list[tuple], dict]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", CURSOR)
        self.early = handle.getListState("early", EARLY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, tuple] = {}
        for frame in rows:
            for row in frame.itertuples(index=False):
                new[int(row.chunk_no)] = (row.piece, bool(row.is_last), int(row.sent))
        yield from self._go_on(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go_on(key, {}, timerValues.getCurrentWatermarkInMs())

    def _go_on(self, key, new: dict[int, tuple], watermark: int) -> Iterator[pd.DataFrame]:
        if out := self.rows(key, new, watermark):
            yield pd.DataFrame(out, columns=self.columns)

    def rows(self, key, new: dict[int, tuple], watermark: int) -> list[tuple]:
        """What new chunks, by number, and the watermark give."""
        held = self.cursor.get() if self.cursor.exists() else None
        next_, consumed, carry, waiting, timer, finished, gaps = held or (0, 0, json.dumps(self.fresh), 0, None, False, False)
        carry = json.loads(carry)
        stored = {v[0]: tuple(v[1:]) for v in self.early.get()} if waiting else {}
        open_ = stored | {n: v for n, v in new.items() if n >= next_}
        latest = max((v[2] for v in new.values()), default=None)
        out: list[tuple] = []
        while True:
            first, pieces = next_, []
            while next_ in open_:
                piece, is_last, _ = open_.pop(next_)
                pieces.append(piece)
                next_, finished = next_ + 1, finished or is_last
            if pieces:
                rows, carry = self.take(key[0], first, consumed, pieces, carry)
                out += rows
                consumed += sum(map(len, pieces))
            if not open_:
                break
            first_sent = min(v[2] for v in open_.values())
            if first_sent + self.patience.gap > watermark and len(open_) <= self.patience.most_waiting:
                break
            behind = min(open_)
            rows, carry = self.skip(key[0], next_, behind - 1, carry)
            out += rows
            next_, gaps = behind, True
        if open_:
            due = min(v[2] for v in open_.values()) + self.patience.gap
        elif finished and not gaps:
            due = None
        elif latest is None and not stored:
            due = timer if timer is not None and timer > watermark else None  # nothing came for so long: the sequence is given up
        else:
            # Behind the end, too, so that what comes late for a gap is known as such.
            due = max(watermark, latest or 0) + self.patience.idle
        self._keep((next_, consumed, json.dumps(carry), len(open_), due, finished, gaps), stored, open_, timer)
        return out

    def _keep(self, cursor: tuple, stored: dict[int, tuple], open_: dict[int, tuple], timer: int | None) -> None:
        due = cursor[4]
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.cursor.clear()
            self.early.clear()
            return
        if due != timer:
            self.handle.registerTimer(due)
        came = [(n, *value) for n, value in open_.items() if n not in stored]
        if any(n not in open_ for n in stored):
            # What is left is written again, and never more than was read.
            if open_:
                self.early.put([(n, *value) for n, value in open_.items()])
            else:
                self.early.clear()
        elif came:
            self.early.appendList(came)
        self.cursor.update(cursor)


class _Value:
    """A value state in memory."""

    __slots__ = ("held",)

    def __init__(self, held=None):
        self.held = held

    def exists(self) -> bool:
        return self.held is not None

    def get(self):
        return self.held

    def update(self, held) -> None:
        self.held = held

    def clear(self) -> None:
        self.held = None


class _Listed:
    """A list state in memory."""

    __slots__ = ("held",)

    def __init__(self, held=()):
        self.held = list(held)

    def get(self) -> Iterator:
        return iter(self.held)

    def put(self, rows: list) -> None:
        self.held = rows

    def appendList(self, rows: list) -> None:
        self.held += rows

    def clear(self) -> None:
        self.held = []


class _Sequence:
    """The handle of one of the sequences that share a state; its cursor knows the timer."""

    __slots__ = ("cursor", "early")

    def __init__(self, cursor=None, early=()):
        self.cursor, self.early = _Value(cursor), _Listed(early)

    def getValueState(self, *_) -> _Value:
        return self.cursor

    def getListState(self, *_) -> _Listed:
        return self.early

    def registerTimer(self, _) -> None:
        pass

    deleteTimer = registerTimer

    @property
    def due(self) -> int:
        return self.cursor.held[4]


class Shared(StatefulProcessor):
    """Feeds the sequences of a bucket to ``ordered`` one by one."""

    def __init__(self, ordered: Ordered):
        self.ordered = ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("shared", SHARED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int | None, dict[int, tuple]] = {}
        for frame in rows:
            ids = [None] * len(frame) if key[0] == NO_NUMBER else frame["seq_id"].tolist()
            for seq_id, n, piece, last, sent in zip(ids, *(frame[c].tolist() for c in ("chunk_no", "piece", "is_last", "sent"))):
                came = new.get(seq_id)
                if came is None:
                    came = new[seq_id] = {}
                came[int(n)] = (piece, bool(last), int(sent))
        yield from self._go_on(*self._held(), new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        watermark = timerValues.getCurrentWatermarkInMs()
        expired = {seq_id: {} for seq_id, sequence in held.items() if sequence.due < watermark}
        yield from self._go_on(held, timer, expired, watermark)

    def _held(self) -> tuple[dict[int | None, _Sequence], int | None]:
        state = self.state.get()
        if state is None:
            return {}, None
        sequences, timer = state
        return {seq_id: _Sequence(cursor, early) for seq_id, cursor, early in json.loads(sequences)}, timer

    def _go_on(self, held: dict, timer: int | None, new: dict, watermark: int) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for seq_id, came in new.items():
            sequence = held.get(seq_id)
            if sequence is None:
                sequence = held[seq_id] = _Sequence()
            self.ordered.init(sequence)
            out += self.ordered.rows((seq_id,), came, watermark)
            if not sequence.cursor.exists():
                del held[seq_id]
        due = min((sequence.due for sequence in held.values()), default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and due != timer:
            self.handle.registerTimer(due)
        if held:
            stored = [(seq_id, sequence.cursor.held, sequence.early.held) for seq_id, sequence in held.items()]
            self.state.update((json.dumps(stored), due))
        elif timer is not None:
            self.state.clear()
        if out:
            # Numbers stay numbers beside a NULL.
            yield pd.DataFrame(out, columns=self.ordered.columns, dtype=object)


class _Scanner(Ordered):
    """The first completed violation of a sequence, and the gaps before it."""

    columns = ["seq_id", "kind", "pattern", "end", "chunk_no", "upto"]
    fresh = {"tail": "", "opened": [], "done": False}

    def __init__(self, patterns, patience: Patience):
        super().__init__(patience)
        self.patterns, self.reach = tuple(patterns), max(p.reach for p in patterns)

    def take(self, key, first, consumed, pieces, carry):
        if carry["done"]:
            return [], carry
        hit, tail, opened = _advance(self.patterns, self.reach, carry["tail"], "".join(pieces), set(carry["opened"]))
        if hit:
            name, end = hit
            chunk_no = first + bisect_left(list(accumulate(map(len, pieces))), end)
            return [(key, "match", name, consumed + end, chunk_no, None)], {"tail": "", "opened": [], "done": True}
        return [], {"tail": tail, "opened": sorted(opened), "done": False}

    def skip(self, key, first, last, carry):
        # No match reaches over a gap.
        return ([] if carry["done"] else [(key, "gap", None, None, first, last)]), self.fresh | {"done": carry["done"]}


class _Carrier(Ordered):
    """Each chunk with the text before it that a match may have begun in."""

    columns = ["seq_id", "chunk_no", "start", "text", "halo"]
    fresh = {"tail": ""}

    def __init__(self, reach: int, patience: Patience):
        super().__init__(patience)
        self.reach = reach

    def take(self, key, first, consumed, pieces, carry):
        rows, tail = [], carry["tail"]
        for chunk_no, piece in enumerate(pieces, first):
            text = tail + piece
            rows.append((key, chunk_no, consumed - len(tail), text, len(tail)))
            consumed, tail = consumed + len(piece), text[max(0, len(text) - self.reach) :]
        return rows, {"tail": tail}

    def skip(self, key, first, last, carry):
        return [], self.fresh


def _in_order(chunks: DataFrame, delay: str, ordered: Ordered, schema: str, buckets: int | None) -> DataFrame:
    """``chunks`` has seq_id, chunk_no (dense from 0), piece, sent (a timestamp) and, if known, is_last."""
    if "is_last" not in chunks.columns:
        chunks = chunks.withColumn("is_last", F.lit(False))
    timed = chunks.withWatermark("sent", delay)
    rows = timed.select("seq_id", "chunk_no", F.coalesce("piece", F.lit("")).alias("piece"), "is_last", F.unix_millis("sent").alias("sent"), F.col("sent").alias("_at"))
    if buckets is None:
        return rows.groupBy("seq_id").transformWithStateInPandas(ordered, schema, "Append", "EventTime")
    # The NULL number has a bucket of its own and another number there: a NULL would make floats of the numbers beside it.
    bucket = F.when(F.col("seq_id").isNull(), NO_NUMBER).otherwise(F.pmod(F.xxhash64("seq_id"), F.lit(buckets)))
    return rows.withColumns({"bucket": bucket, "seq_id": F.coalesce("seq_id", F.lit(NO_NUMBER))}).groupBy("bucket").transformWithStateInPandas(Shared(ordered), schema, "Append", "EventTime")


def first_completions(chunks: DataFrame, delay: str = "1 minute", patience: Patience = Patience(), patterns=P.PII, buckets: int | None = BUCKETS) -> DataFrame:
    """(seq_id, kind, pattern, end, chunk_no, upto): the first completed violation of a sequence (``match``, with the characters up to its
    end), and before it a row for each run of chunks that was given up (``gap``, from chunk_no to upto).

    Characters are those that came. After the match a sequence gives no more rows. Chunks later than the watermark, which is ``delay`` behind
    the latest event time, are dropped by the engine; their gaps are reported all the same. A query is restarted with the ``buckets`` that it was
    begun with; more of them make smaller states, and None gives each sequence its own.
    """
    schema = "seq_id BIGINT, kind STRING, pattern STRING, end BIGINT, chunk_no INT, upto INT"
    return _in_order(chunks, delay, _Scanner(patterns, patience), schema, buckets)


def carried(chunks: DataFrame, reach: int, delay: str = "1 minute", patience: Patience = Patience(), buckets: int | None = BUCKETS) -> DataFrame:
    """(seq_id, chunk_no, start, text, halo): chunks in order, each behind the last ``reach`` characters before it (``halo`` of them), with the offset
    of its text among the characters that came. Nothing is carried over a gap. ``buckets``: see :func:`first_completions`."""
    schema = "seq_id BIGINT, chunk_no INT, start BIGINT, text STRING, halo INT"
    return _in_order(chunks, delay, _Carrier(reach, patience), schema, buckets)
