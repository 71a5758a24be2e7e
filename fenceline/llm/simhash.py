"""Near-duplicates by SimHash, candidates by pigeonring filtering.

A text's fingerprint has 64 bits: a bit is set if more than half of the hashes of its word shingles have it set.
Two fingerprints are linked at ``bits`` or fewer differing bits.

Pigeonring: cut the 64 bits into m = 2 * bits + 1 segments on a ring. If two fingerprints differ in
at most ``bits`` bits, some segment starts a chain whose first l segments differ together in at
most l * bits / m bits, for every l. The first segments of such a chain can be skipped
only within that budget, so each start gives a few ways in which four segments agree exactly; these are the
probe keys (about 28 bits). Fingerprints with a common key are candidates, chains that
exceed their budget at any length are dropped, and only the others get the full Hamming check.

Copies cost nothing: all linking is between distinct fingerprints. Inside a key only a spanning
forest of the links is emitted, never all pairs. A key with more than ``BLOCK`` fingerprints is
dealt into blocks, and each pair of blocks is a group of its own.

Nulls and texts without a word have fingerprint 0 and are linked like any other. A null ``doc_id`` never
is the smallest one; a component without any other id has a null id. Repeated rows share a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import lookup_join, written
from .components import components

WIDTH = 4
BITS = 4
SEED = 42
EXACT = 4
BLOCK = 4096
# Shingles whose bits are summed at once.
AT_ONCE = 65_536


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """As an unsigned number. Words are runs without ASCII white space, A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    last = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, last, AT_ONCE):
        spans = zip(starts[k : min(k + AT_ONCE, last)], ends[min(width, len(words)) - 1 + k :], strict=False)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` (the ``key``), ``row_hash`` (of all columns) and ``fp``, the fingerprint as a signed long."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py() or b"", width) for t in texts], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "row_hash", "fp"])

    own = docs.select(F.col(f"`{key}`").alias("doc_id"), row_hash(docs).alias("row_hash"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(sign, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, row_hash long, fp long")


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns])


def borders(segments: int) -> list[int]:
    return [64 * i // segments for i in range(segments + 1)]


def probes(segments: int, bits: int, exact: int = EXACT) -> list[tuple[int, ...]]:
    """The places, from the start of a chain, of the first ``exact`` segments that agree, in all ways that keep the
    chain within its budgets."""
    found = []

    def walk(place: int, skipped: int, agree: tuple[int, ...]) -> None:
        if len(agree) == exact or place == segments:
            found.append(agree)
            return
        walk(place + 1, skipped, (*agree, place))
        if skipped + 1 <= (place + 1) * bits // segments:
            walk(place + 1, skipped + 1, agree)

    walk(0, 0, ())
    return found


def probe_keys(fp: Column, bits: int) -> Column:
    """All probe keys of a fingerprint: the number of start and places, then the bits that must agree."""
    segments = 2 * bits + 1
    at, ways = borders(segments), probes(segments, bits)
    keys = []
    for start in range(segments):
        for n, places in enumerate(ways):
            mask = 0
            for p in places:
                s = (start + p) % segments
                mask |= ((1 << (at[s + 1] - at[s])) - 1) << at[s]
            signed = mask - (1 << 64) if mask >> 63 else mask
            keys.append(F.struct(F.lit(start * len(ways) + n).alias("way"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("agree")))
    return F.array(*keys)


def within(a: np.ndarray, b: np.ndarray, start: np.ndarray, bits: int) -> np.ndarray:
    """Places of the pairs that pass their chain's budgets and then the Hamming check. ``start``: the number of
    the chain's first segment."""
    segments = 2 * bits + 1
    at = borders(segments)
    places = np.arange(len(a))
    diff = a ^ b
    for length in range(1, segments):
        # The first bit after the chain's ``length`` segments, on the ring.
        end = np.array([at[(s + length) % segments] + (64 if s + length >= segments else 0) for s in range(segments)])
        size = (end - np.array(at[:-1])).astype(np.uint64)
        first = np.array(at[:-1], dtype=np.uint64)[start[places]]
        x = diff[places]
        turned = (x >> first) | (x << ((np.uint64(64) - first) % np.uint64(64)))
        mask = (np.uint64(1) << size[start[places]]) - np.uint64(1)
        places = places[np.bitwise_count(turned & mask) <= length * bits // segments]
        if not len(places):
            return places
    return places[np.bitwise_count(diff[places]) <= bits]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node that the links (a, b) reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        label = new[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _group_links(way: np.ndarray, group: np.ndarray, fp: np.ndarray, ways: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (positions) inside the runs of equal ``group``."""
    n = len(fp)
    found_a, found_b = [], []
    start = way // ways
    runs = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    sizes = np.diff(runs)
    end = np.repeat(runs[1:], sizes)
    rows = np.flatnonzero(end - np.arange(n) > 1)
    step = 1
    while len(rows):
        ok = within(fp[rows], fp[rows + step], start[rows], bits)
        found_a.append(rows[ok])
        found_b.append(rows[ok] + step)
        step += 1
        rows = rows[rows + step < end[rows]]
        if sum(map(len, found_a)) > 1_000_000:
            # Contract what has been found; its forest links the same rows.
            label = forest(n, np.concatenate(found_a), np.concatenate(found_b))
            moved = np.flatnonzero(label != np.arange(n))
            found_a, found_b = [moved], [label[moved]]
    if not found_a:
        return np.zeros(0, int), np.zeros(0, int)
    label = forest(n, np.concatenate(found_a), np.concatenate(found_b))
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def links(fps: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` exactly as all pairs within ``bits`` do."""
    ways = len(probes(2 * bits + 1, bits))
    keyed = fps.select("fp", F.explode(probe_keys(F.col("fp"), bits)).alias("k")).select("k.way", "k.agree", "fp")
    sizes = keyed.groupBy("way", "agree").agg(F.count("*").alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    # A pair of blocks is one group; keys of one block have the group (0, 0).
    # Spark takes what an explode makes for as small as what goes into it and would broadcast all keys: the join is a merge, whatever it expects.
    grouped = (
        keyed.join(sizes.hint("merge"), ["way", "agree"])
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("way", "agree", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), "fp")
        .withColumn("g", F.xxhash64("way", "agree", "lo", "hi"))
        .select("way", "g", "fp")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, "i4"), np.zeros(0, "i8"), np.zeros(0, "u8")]

        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _group_links(*parts, ways, bits)
            pairs = np.unique(np.stack([parts[2][a], parts[2][b]], axis=1), axis=0) if len(a) else np.zeros((0, 2), "u8")
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view("i8")) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view("u8")]
            all_ = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            last = np.flatnonzero(all_[1] != all_[1][-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            kept = [x[cut:] for x in all_]
            if cut:
                yield out([x[:cut] for x in all_])
        if len(kept[0]):
            yield out(kept)

    # Grouped by hash: groups whose hashes agree by chance are compared with each other, too.
    dealt = grouped.repartition("g").sortWithinPartitions("g", "way")
    return dealt.mapInArrow(join, "a long, b long")


def classes(signed: DataFrame, bits: int = BITS) -> DataFrame:
    """``fp``, ``root`` (a number of its component) and ``component_id`` for every distinct fingerprint of ``signed``
    (doc_id, fp)."""
    fps = written(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = components(links(fps, bits)).withColumnsRenamed({"node": "fp"})
    rooted = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(lookup_join(rooted, written(least, "least"), "root").select("fp", "root", "component_id"), "classes")


def clustered(docs: DataFrame, width: int = WIDTH, bits: int = BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``row_hash``, ``fp``, ``root`` and ``component_id`` of every row."""
    signed = written(fingerprints(docs, width, key, text), "signed")
    # One fingerprint may belong to a large part of all rows.
    return lookup_join(signed, classes(signed, bits), "fp")


def one_of_each(docs: DataFrame, width: int = WIDTH, bits: int = BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest ``doc_id``, nulls last, then the smallest hash of
    the row; of rows that are equal altogether one stays."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row_hash").alias("h"))
    named = F.coalesce(F.col("o.id").cast("string"), F.lit("null"))
    found = written(clustered(docs, width, bits, key, text).select("root", order.alias("o")), "clustered")
    times = found.groupBy(F.col("o.h").alias("_hash"), named.alias("_id")).agg(F.count("*").alias("_n"))
    chosen = found.groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.h").alias("_hash"), named.alias("_id")).distinct()
    first = written(chosen.join(times, ["_hash", "_id"]), "chosen")
    own = F.coalesce(F.col(f"row.`{key}`").cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), row_hash(docs).alias("_hash")).withColumn("_id", own)
    # Keys are looked up; of whole rows only those move that occur more than once.
    matched = lookup_join(rows, first, ["_hash", "_id"])
    again = matched.where("_n > 1").dropDuplicates(["_hash", "_id"])
    return matched.where("_n = 1").unionByName(again).select("row.*")
