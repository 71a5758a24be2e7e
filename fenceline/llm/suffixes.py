"""Removal of long repeated passages by minimizer hashing, with a logarithmic family of key tables.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else, too.

Anchors. Of the ``length - GRAM + 1`` grams in a string of ``length`` bytes, that with the smallest hash is the
string's anchor. Equal strings have their anchors at equal places, so only places that
are anchors are indexed, about one in 70. An entry's key is the first three bytes of the anchor's gram and 40 bits of the gram's
hash: equal strings have equal keys. The index holds no positions and no order of suffixes.

Index family. ``Index.add`` takes a batch of entries, counts its keys, joins them
with every level by equality, and notes the keys that occur again, in the batch
or in a level. The batch becomes a level; before the next one comes, levels of equal size are merged,
so n batches lie in about log n levels and a key is rewritten log n times.

Strings. All strings of one anchor make a block. Blocks that occur twice as a whole are removed as a
whole; of different blocks with one key, one copy each, the single strings are compared. So groups of copies cost no pairs, and
counts are summed up before they are shuffled.

Texts are known by two hashes of their content: copies of a text share their spans. A null text is empty; texts shorter than
``length`` keep all bytes. Repeated rows are copies of each other, whatever their ids. Strings are compared by 64-bit hashes,
blocks by a hash and their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import lookup_join, written

LENGTH = 200
GRAM = 48
BATCHES = 3
# Different blocks of one key that one task compares; beyond, their strings are counted by Spark.
MANY = 50_000
_BASE = 0x9E3779B97F4A7C15 | 1
_ALL = (1 << 64) - 1
# Starts of strings that are handled at once.
CHUNK = 1 << 20


def _tables(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES = _tables()


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base & _ALL, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


_UP = _powers(1 << 16, _BASE)
_DOWN = _powers(1 << 16, pow(_BASE, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of the substrings of a text, by sums over its prefixes."""

    def __init__(self, data: np.ndarray):
        global _UP, _DOWN
        n = len(data)
        if n >= len(_UP):
            _UP, _DOWN = _powers(2 * n, _BASE), _powers(2 * n, pow(_BASE, -1, 1 << 64))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * _UP[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * _DOWN[start])

    def all(self, first: int, last: int, size: int) -> np.ndarray:
        """Those of ``size`` bytes from each start in [first, last)."""
        return _mixed((self.sums[first + size : last + size] - self.sums[first:last]) * _DOWN[first:last])


def anchors(data: np.ndarray, hashes: Hashes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first start and last start of each run of strings with one anchor."""
    starts = len(data) - length + 1
    if starts <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    width = length - gram + 1
    grams = hashes.all(0, len(data) - gram + 1, gram)
    # 40 bits of hash over 24 bits of place: the minimum is the leftmost smallest gram.
    low = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:starts], low[width - span : width - span + starts])
    at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], starts] - 1


def entries_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Key, block hash, first start and last start of each anchor.

    A text is taken in parts of CHUNK starts, so memory does not grow with it. A block on the border of two parts falls into
    two, which differ from its copies as a whole; their strings are compared one by one."""
    found = []
    for k in range(0, max(1, len(data) - length + 1), CHUNK):
        part = data[k : k + CHUNK + length - 1]
        hashes = Hashes(part)
        at, first, last = anchors(part, hashes, length, gram)
        own = hashes.of(at, at + gram)
        lead = (part[at].astype(np.uint64) << np.uint64(16)) | (part[at + 1].astype(np.uint64) << np.uint64(8)) | part[at + 2]
        # Signed, in the order of the leading bytes.
        key = ((lead << np.uint64(40)) | (own >> np.uint64(24))) ^ np.uint64(1 << 63)
        block = hashes.of(first, last + length) ^ (last - first).astype(np.uint64) * np.uint64(_BASE)
        found.append((key.view("i8"), block.view("i8"), first + k, last + k))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


class Index:
    """The family of levels, tables of ``key`` and ``n`` in the shared folder, and the keys seen again so far."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.again: list[DataFrame] = []

    def add(self, keys: DataFrame) -> None:
        """Index a batch of entries (``key``)."""
        self._merge()
        batch = written(keys.groupBy("key").agg(F.count("*").alias("n")).sortWithinPartitions("key"), "suffixes")
        again = batch.where("n > 1").select("key")
        for _, level in self.levels:
            again = again.unionByName(batch.select("key").join(level.select("key").hint("merge"), "key"))
        self.again.append(written(again.distinct(), "again"))
        self.levels.append((1, batch))

    def _merge(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            merged = a.unionByName(b).groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key")
            self.levels.append((2 * size, written(merged, "suffixes")))

    def repeated(self) -> DataFrame:
        """The keys that occur more than once in what was added."""
        found = self.again[0]
        for more in self.again[1:]:
            found = found.unionByName(more)
        return written(found.distinct(), "repeated")


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """Every row as ``row``, its text and the two hashes by which the text is known."""
    t = F.coalesce(docs[f"`{text}`"], F.lit(""))
    return docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        t.cast("binary").alias("text"),
        F.xxhash64(t).alias("t1"),
        # The text comes last: hashed first, its own hash would be all that is known of it.
        F.xxhash64(F.lit(1), t).alias("t2"),
    )


def entries(texts: DataFrame, batches: int, length: int, gram: int) -> DataFrame:
    """The sparse suffixes of all texts: key, block, lo, hi (first and last start of the block's strings) and batch."""

    def emit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 500):
                piece = part.slice(at, 500)
                own = [entries_of(np.frombuffer(t.as_buffer(), dtype=np.uint8), length, gram) for t in piece.column(2)]
                again = pa.array(np.repeat(np.arange(piece.num_rows), [len(e[0]) for e in own]))
                key, block, lo, hi = (np.concatenate([e[i] for e in own]) for i in range(4))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(again), piece.column(1).take(again), pa.array(key), pa.array(block), pa.array(lo.astype("i4")), pa.array(hi.astype("i4"))],
                    names=["t1", "t2", "key", "block", "lo", "hi"],
                )

    long_enough = texts.where(F.length("text") >= length).select("t1", "t2", "text")
    found = long_enough.mapInArrow(emit, "t1 long, t2 long, key long, block long, lo int, hi int")
    return found.withColumn("batch", F.pmod("t1", F.lit(batches)).cast("int"))


def _cut(joined: DataFrame, length: int) -> DataFrame:
    """The bytes of the blocks that ``refs`` asks for, once for each text and task."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for part in parts:
            t1, t2 = part.column(0).to_numpy(), part.column(1).to_numpy()
            rows, refs, data = [], [], []
            for i, (known, text) in enumerate(zip(zip(t1.tolist(), t2.tolist(), strict=True), part.column(2), strict=True)):
                if known not in seen:
                    seen.add(known)
                    view = memoryview(text.as_buffer())
                    for r in part.column(3)[i].as_py():
                        rows.append(i)
                        refs.append(r)
                        data.append(bytes(view[r["lo"] : r["hi"] + length]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["key"] for r in refs], pa.int64()), pa.array([r["many"] for r in refs], pa.bool_()), pa.array(t1[rows], pa.int64()), pa.array(t2[rows], pa.int64()), pa.array([r["lo"] for r in refs], pa.int32()), pa.array(data, pa.binary())],
                names=["key", "many", "t1", "t2", "lo", "data"],
            )

    return joined.mapInArrow(cut, "key long, many boolean, t1 long, t2 long, lo int, data binary")


def _strings(data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all strings of the blocks, with their block's number and their place in it."""
    sizes = np.array([len(d) - length + 1 for d in data])
    joined = np.frombuffer(b"".join(data), dtype=np.uint8)
    first = np.r_[0, np.cumsum(sizes + length - 1)[:-1]]
    block = np.repeat(np.arange(len(data)), sizes)
    place = np.arange(len(block)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    start = first[block] + place
    return Hashes(joined).of(start, start + length), block, place


def _compared(blocks: DataFrame, length: int) -> DataFrame:
    """The spans of strings that two different blocks of one key share; all rows of a key lie together."""

    def spans(key: list[int], t1: list[int], t2: list[int], lo: list[int], data: list[bytes]) -> pa.RecordBatch:
        if not data:
            return pa.RecordBatch.from_pydict({n: pa.array([], pa.int64()) for n in ("t1", "t2", "start", "end")})
        hashes, block, place = _strings(data, length)
        group = np.unique(np.array(key), return_inverse=True)[1][block]
        # Equal strings of one key are neighbours.
        order = np.lexsort((hashes, group))
        same = (hashes[order][1:] == hashes[order][:-1]) & (group[order][1:] == group[order][:-1])
        twice = np.zeros(len(order), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        b, p = block[twice], place[twice]
        head = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (p[1:] != p[:-1] + 1)]) if len(b) else np.zeros(0, int)
        tail = np.r_[head[1:], len(b)] - 1 if len(b) else head
        own = b[head]
        base = np.array(lo)[own]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(t1)[own], pa.int64()), pa.array(np.array(t2)[own], pa.int64()), pa.array(base + p[head], pa.int64()), pa.array(base + p[tail] + length, pa.int64())],
            names=["t1", "t2", "start", "end"],
        )

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list] = [[] for _ in range(5)]
        size = 0
        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if kept[0] and row[0] != kept[0][-1] and size > 500_000:
                    yield spans(*kept)
                    kept, size = [[] for _ in range(5)], 0
                for column, value in zip(kept, row, strict=True):
                    column.append(value)
                size += len(row[4])
        yield spans(*kept)

    dealt = blocks.select("key", "t1", "t2", "lo", "data").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(compare, "t1 long, t2 long, start long, end long")


def _exploded(blocks: DataFrame, length: int) -> DataFrame:
    """As ``_compared``, for keys with very many blocks: the strings themselves are counted and joined."""

    def emit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 1000):
                piece = part.slice(at, 1000)
                hashes, block, place = _strings(piece.column(3).to_pylist(), length)
                start = piece.column(2).to_numpy()[block] + place
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view("i8")), piece.column(0).take(pa.array(block)), piece.column(1).take(pa.array(block)), pa.array(start.astype("i8"))],
                    names=["string", "t1", "t2", "start"],
                )

    strings = written(blocks.select("t1", "t2", "lo", "data").mapInArrow(emit, "string long, t1 long, t2 long, start long").distinct(), "strings")
    twice = strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    return strings.join(twice, "string").select("t1", "t2", "start", (F.col("start") + length).alias("end"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, many: int = MANY) -> DataFrame:
    """``t1``, ``t2`` and ``spans``: for each text with repeated strings the maximal runs that they cover, in order."""
    stored = written(entries(texts, batches, length, gram), "entries")
    index = Index()
    for b in range(batches):
        index.add(stored.where(F.col("batch") == b).select("key"))
    candidates = written(lookup_join(stored.drop("batch"), index.repeated(), "key", "left_semi"), "candidates")
    blocks = candidates.groupBy("block", (F.col("hi") - F.col("lo")).alias("size"))
    blocks = written(blocks.agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "lo", "hi", "key")).alias("one")), "blocks")
    whole = candidates.withColumn("size", F.col("hi") - F.col("lo")).join(blocks.where("n > 1").select("block", "size"), ["block", "size"])
    whole = whole.select("t1", "t2", F.col("lo").cast("long").alias("start"), (F.col("hi") + length).cast("long").alias("end"))

    different = blocks.groupBy(F.col("one.key").alias("key")).agg(F.count("*").alias("_n")).where("_n > 1")
    one = F.struct(F.col("one.key").alias("key"), (F.col("_n") > many).alias("many"), F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"))
    refs = (
        blocks.withColumn("key", F.col("one.key"))
        .join(different, "key")
        .groupBy("one.t1", "one.t2")
        .agg(F.collect_list(one).alias("refs"))
    )
    asked = lookup_join(texts.select("t1", "t2", "text"), written(refs, "refs"), ["t1", "t2"])
    cut = written(_cut(asked.select("t1", "t2", "text", "refs"), length), "cut")
    spans = whole.unionByName(_compared(cut.where("not many"), length))
    if not cut.where("many").isEmpty():
        spans = spans.unionByName(_exploded(cut.where("many"), length))

    def joined(runs, span):
        last = F.element_at(runs, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        head = F.slice(runs, 1, F.size(runs) - 1)
        touches = (F.size(runs) > 0) & (F.get(runs, F.size(runs) - 1)["end"] >= span["start"])
        return F.when(touches, F.concat(head, F.array(longer))).otherwise(F.concat(runs, F.array(span)))

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    sets = spans.groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return sets.withColumn("spans", F.aggregate("spans", none, joined))


def cleaned(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, many: int = MANY, text: str = "text") -> DataFrame:
    """``row``, ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed`` and ``n_spans`` of every row of ``docs``."""
    texts = _texts(docs, text)
    spans = written(repeated_spans(texts, length, gram, batches, many), "spans")
    both = lookup_join(texts, spans, ["t1", "t2"], "left")

    def remove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            kept, sizes, removed, runs = [], [], [], []
            for text_, spans_ in zip(part.column(1), part.column(2), strict=True):
                data, cuts = text_.as_py(), spans_.as_py() or []
                at, rest = 0, []
                for s in cuts:
                    rest.append(data[at : s["start"]])
                    at = s["end"]
                rest = b"".join([*rest, data[at:]])
                kept.append(rest)
                sizes.append(len(data))
                removed.append(len(data) - len(rest))
                runs.append(len(cuts))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs))],
                names=["row", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    kind = both.schema["row"].dataType.simpleString()
    return both.select("row", "text", "spans").mapInArrow(remove, f"row {kind}, kept binary, n_bytes long, n_removed long, n_spans long")
