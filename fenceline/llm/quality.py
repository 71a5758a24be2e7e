"""A quality classifier on supervised subword embeddings.

A text's features are its words, the character 3- to 5-grams of its words, and two marks: a word that repeats the one
before it, and a word of a line that repeats an earlier line. Features are hashed into buckets, each bucket has a learned
vector, a text is the average of its features' vectors, and a softmax over two outputs gives the score. Training
is numpy stochastic gradient descent over a bounded sample of labelled rows that have a document: those with the smallest hashes of their ids, at most
``FIT_ROWS`` rows and ``FIT_BYTES`` bytes of distinct words. Texts of any length take part: their words are counted where they
lie, and only the counts reach the driver.

As output is linear in the average, a word's share of the result is one number; ``scored`` sends the
buckets' numbers to all workers (their size is a parameter) and keeps each word's sum in a cache.

Null and empty texts have no features; their score is the softmax of the bias alone. Labels that are null, and labels
of ids without a document, are ignored; repeated rows count each time. Labels are the only other input of the fit, and none of a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

BUCKETS = 1 << 18
DIMENSIONS = 16
GRAMS = (3, 4, 5)
FIT_ROWS = 3_000
FIT_BYTES = 5_000_000
WORDS_AT_ONCE = 10_000
STEPS = 400
BATCH = 32
RATE = 3.0
CACHE_ROWS = 300_000
THRESHOLD = 0.3
SEED = 11
SAME_WORD = "\x00word"
SAME_LINE = "\x00line"


def marked_words(text: str) -> list[str]:
    """The words of a text, and a mark for each repetition."""
    words = text.split()
    marks = [SAME_WORD] * sum(a == b for a, b in zip(words, words[1:], strict=False))
    seen = set()
    for line in text.split("\n"):
        own = line.split()
        if own:
            key = " ".join(own)
            if key in seen:
                marks += [SAME_LINE] * len(own)
            seen.add(key)
    return words + marks


def features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the words, and the number of features of each word, in order."""
    spelled = [f"<{w}>" for w in words]
    sizes = np.array([len(s) for s in spelled], dtype=np.int64)
    chars = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    ids = [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64) % np.uint64(buckets)]
    owner = [np.arange(len(words))]
    for n in GRAMS:
        at = np.flatnonzero(np.arange(len(chars)) + n <= end)
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = (h ^ chars[at + j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        ids.append((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets))
        owner.append(word[at])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(ids).astype(np.int32)[order], np.bincount(owners, minlength=len(words))


@dataclass
class Model:
    """What scoring needs: each bucket's share of the difference of the outputs, and the bias."""

    shares: np.ndarray
    bias: float


def fitted(texts: Iterable[tuple[list[str], list[int]]], labels: list[int], steps: int = STEPS, seed: int = SEED) -> Model:
    """``steps`` batches of stochastic gradient descent over the texts, given as their different words (and marks) and how often each
    occurs. With one kind of label only, the bias says which."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 0.0 if not len(y) else 4.0 * (2 * int(y[0]) - 1))
    number: dict[str, int] = {}
    docs = []
    for own, counts in texts:
        docs.append((np.array([number.setdefault(w, len(number)) for w in own], dtype=np.int64), np.array(counts, dtype=np.float64)))
    words = list(number)
    # A few words at a time: forming their features takes many times the room of the result.
    parts = [features(words[k : k + WORDS_AT_ONCE]) for k in range(0, len(words), WORDS_AT_ONCE)]
    ids = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int32)])
    sizes = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
    del parts, words, number
    first = np.r_[0, np.cumsum(sizes)]
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    out, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
    step = 0
    while step < steps:
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            if step == steps:
                break
            step += 1
            rows = order[k : k + BATCH]
            w = np.concatenate([docs[r][0] for r in rows])
            if not len(w):
                continue
            n = np.concatenate([docs[r][1] for r in rows])
            doc = np.repeat(np.arange(len(rows)), [len(docs[r][0]) for r in rows])
            total = np.bincount(doc, weights=n * sizes[w], minlength=len(rows))
            each = sizes[w]
            at = np.repeat(first[w] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())
            f, d = ids[at], np.repeat(doc, each)
            share = np.repeat(n / total[doc], each)
            mean = np.stack([np.bincount(d, weights=vectors[f, j] * share, minlength=len(rows)) for j in range(DIMENSIONS)], axis=1)
            z = mean @ out + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            p = z / z.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            rate = RATE * (1 - (step - 1) / steps)
            back = (p @ out.T) * rate
            out -= rate / len(rows) * (mean.T @ p)
            bias -= rate / len(rows) * p.sum(axis=0)
            used, place = np.unique(f, return_inverse=True)
            for j in range(DIMENSIONS):
                vectors[used, j] -= np.bincount(place, weights=back[d, j] * share, minlength=len(used))
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


def word_counts(texts: DataFrame) -> DataFrame:
    """The rows with ``words`` (different ones) and ``counts`` instead of their ``text``, the last column."""
    kept = texts.columns[:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = Counter(marked_words(batch.column(len(kept))[k].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(k, 1).columns[:-1], pa.array([list(found)], pa.list_(pa.string())), pa.array([list(found.values())], pa.list_(pa.int64()))],
                    names=[*kept, "words", "counts"],
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return texts.mapInArrow(count, f"{kinds}, words array<string>, counts array<long>")


def trained(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """The model fitted to labelled rows outside fold 0."""
    own = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y"))
    own = own.where((fold(F.col("id")) != 0) & F.col("id").isNotNull() & F.col("y").isin(0, 1))
    # Labels without a document take no room.
    own = own.join(docs.select(F.col(f"`{key}`").alias("id")).distinct(), "id", "left_semi")
    rank = F.xxhash64(F.lit(SEED), "id")
    # FIT_ROWS rows at most, so they may be sent to every task.
    chosen = F.broadcast(own.withColumn("rank", rank).orderBy("rank", "id", "y").limit(FIT_ROWS))
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    counted = word_counts(texts.join(chosen, "id").select("rank", "id", "y", F.xxhash64("text").alias("h"), "text"))
    sample = written(counted, "sample")
    kept, size, last = 0, 0, None
    room = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w))
    order = sample.select("rank", "id", "y", "h", room.alias("n")).orderBy("rank", "id", "y", "h").limit(FIT_ROWS)
    for r in order.collect():
        size += r["n"]
        if kept and size > FIT_BYTES:
            break
        kept, last = kept + 1, r["rank"]
    if last is None:
        return fitted([], [])
    rows = sample.where(F.col("rank") <= last).orderBy("rank", "id", "y", "h").limit(kept).select("words", "counts", "y").toArrow()
    # One text's words at a time become Python's: all of them would take several times the room.
    texts_ = ((w.as_py(), n.as_py()) for w, n in zip(rows["words"], rows["counts"], strict=True))
    return fitted(texts_, rows["y"].to_pylist())


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``row``, ``score`` and ``predicted`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.shares, model.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, bias = shared.value
        known: dict[str, complex] = {}

        def learn(words: list[str]) -> None:
            ids, sizes = features(words)
            first = np.r_[0, np.cumsum(sizes)[:-1]]
            # A word's sum and number of features as one number, so that one sum over a text gives both.
            known.update(zip(words, (np.add.reduceat(shares[ids], first) + 1j * sizes).tolist(), strict=True))

        for batch in batches:
            if len(known) > CACHE_ROWS:
                known.clear()
            values = []
            for group in _groups(batch.column(batch.num_columns - 1)):
                split = [marked_words(t) for t in group]
                missing = list(set().union(*split).difference(known))
                if missing:
                    learn(missing)
                sums = [sum(map(known.__getitem__, ws)) for ws in split]
                values += [s.real / s.imag if s else 0.0 for s in sums]
            z = np.array(values) + bias
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(1 / (1 + np.exp(-z)))], names=[*batch.schema.names[:-1], "score"]
            )

    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("_text"))
    kind = own.schema["row"].dataType.simpleString()
    scores = own.mapInArrow(score, f"row {kind}, score double")
    return scores.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _groups(texts: pa.Array, bytes_: int = 1_000_000) -> Iterator[list[str]]:
    """Consecutive texts of about so many bytes, or one."""
    start, size = 0, 0
    sizes = pc.binary_length(texts.cast(pa.binary())).to_pylist()
    for i, s in enumerate(sizes):
        if i > start and size + s > bytes_:
            yield texts.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += s
    if len(sizes) > start:
        yield texts.slice(start).to_pylist()
