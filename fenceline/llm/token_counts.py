"""Token counts by a two-tier lookup inside the scan: no pre-token is shuffled.

A pre-token is a run of bytes without ASCII white space. The tokenizer drops white space and never
merges across it, so a text's count is the sum over its pre-tokens. Tier one is a compact table of
the lengths of frequent pre-tokens, sent to all workers; its size is a parameter. Tier two is a
cache in each worker: pre-tokens outside the table are encoded by the tokenizer once and kept, up to
a bound, beyond which the worker starts again from tier one. Both tiers decide only how often
the tokenizer is called, never a count.

The table comes from all documents: every task sums up its own pre-tokens, sends its most
frequent ones (``PER_TASK``), and the sums of those are ordered.

Null and empty texts have no tokens. Rows are counted one by one, other columns are left alone.
"""

from __future__ import annotations

import heapq
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_ROWS = 50_000
PER_TASK = 5_000
CACHE_ROWS = 400_000
# Longer pre-tokens are encoded anew each time; they would fill the cache with rare text.
LONGEST_KEPT = 48
# Texts of so many bytes are split at once.
AT_ONCE = 2_000_000


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _lengths(tokenizer, words: list[bytes]) -> list[int]:
    encoded = tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)
    return [len(e.ids) for e in encoded]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches, each of about AT_ONCE bytes of text or one row, with the texts in the last column."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        start, size = 0, 0
        sizes = [0 if s is None else s for s in pc.binary_length(texts).to_pylist()]
        for i, s in enumerate(sizes):
            if i > start and size + s > AT_ONCE:
                yield batch.slice(start, i - start), [x or b"" for x in texts.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += s
        if len(sizes) > start:
            yield batch.slice(start), [x or b"" for x in texts.slice(start).to_pylist()]


def frequent(docs: DataFrame, text: str = "text", rows: int = TABLE_ROWS) -> DataFrame:
    """The most frequent pre-tokens (``word`` binary) of all documents, ``rows`` at most.

    A task drops its rare half when it holds more than CACHE_ROWS different ones.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for _, texts in _texts(batches):
            for t in texts:
                counts.update(t.split())
            if len(counts) > CACHE_ROWS:
                counts = Counter(dict(heapq.nlargest(CACHE_ROWS // 2, counts.items(), key=lambda x: x[1])))
        short = ((w, n) for w, n in counts.items() if len(w) <= LONGEST_KEPT and n > 1)
        top = heapq.nlargest(PER_TASK, short, key=lambda x: x[1])
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.binary()), "n": pa.array([n for _, n in top], pa.int64())})

    parts = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(summed, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(rows).select("word")


def counted(docs: DataFrame, tokenizer: str, text: str = "text", table_rows: int = TABLE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (its ``doc_id``), ``n_bytes`` and ``n_tokens``.

    ``tokenizer`` is the path of a file of the ``tokenizers`` library that every worker can read,
    whose pre-tokenizer drops white space.
    """
    spark = docs.sparkSession
    words = [bytes(r["word"]) for r in frequent(docs, text, table_rows).collect()]
    table = spark.sparkContext.broadcast((words, bytes(min(n, 255) for n in _lengths(_tokenizer(tokenizer), words))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _tokenizer(tokenizer)
        tier_one = dict(zip(*table.value, strict=True))
        known = dict(tier_one)
        for batch, texts in _texts(batches):
            split = [t.split() for t in texts]
            missing = list(set().union(*split).difference(known)) if split else []
            found = {}
            for k in range(0, len(missing), 20_000):
                part = missing[k : k + 20_000]
                found.update(zip(part, _lengths(library, part), strict=True))
            if len(known) + len(found) > CACHE_ROWS:
                # A text's own words are looked up in ``found``, whatever the cache still holds.
                sums = [sum(known[w] if w in known else found[w] for w in ws) for ws in split]
                known = dict(tier_one)
            else:
                known.update(found)
                sums = [sum(map(known.__getitem__, ws)) for ws in split]
                for w in found:
                    if len(w) > LONGEST_KEPT:
                        del known[w]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(map(len, texts), pa.int64()), pa.array(sums, pa.int64())],
                names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"],
            )

    own = docs.select(*[F.col(f"`{c}`") for c in keep or ["doc_id"]], F.col(f"`{text}`").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(count, f"{kept}, n_bytes long, n_tokens long")
