"""Links between texts by the Jaccard similarity of their word shingles, by signature trees.

Two texts are linked if their shingle sets share at least ``PERCENT`` percent of their union. What comes out is the component of
each text; inside a component not every link is looked at, but no two linked texts are in different ones.

1. Texts become sets of 64-bit hashes of their shingles; equal sets are one from here on.
2. A set's head are its smallest hashes, so many that a linked pair shares at least ``SHARE`` of the required overlap within the heads. A set
   too few of whose head hashes occur in other heads has no link. This leaves few sets.
3. Sets that share one of their first head hashes meet, with all their hashes, in a signature tree: leaves are sets, nodes
   hold the OR of their bitmaps and the range of their sizes. A dual traversal of the tree with itself drops pairs of nodes whose greatest possible overlap
   is too small, and pairs that are connected already; others are compared. Groups are dealt into blocks (``BLOCK`` sets,
   ``BLOCK_HASHES`` hashes), each with the group's outermost sets, so that blocks grow together.
4. What step 3 connects counts as one component. Head hashes that two components share go on: a set meets others at its rarest ones, as
   many as make sure that linked sets meet, in trees of bitmaps alone. Pairs that pass the bounds are compared by their sets: first one
   of each pair of components that have more than one set between them, then, components brought up to date, all that are left.

A pair that shares some of its ``LEADS`` rarest hashes is only looked at where the smallest of them brings it together. Bitmaps have four bits or
more a hash, up to ``WIDEST``; a group of at most ``LEAF`` sets is one leaf, whose pairs are tested one by one.

Words are runs without ASCII white space, A-Z in lower case. A text with fewer words than a shingle has one, the whole sequence. Null and
empty texts have an empty set, no link, and their own ``doc_id`` as component. A null ``doc_id`` is never the smallest one. Repeated rows are linked.
The words of one text are in a worker's memory at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import lookup_join, written
from .components import components

WIDTH = 4
PERCENT = 85
# The part of the required overlap that linked pairs share within their heads, 1 in so many.
SHARE = 10
# First head hashes by which a set is routed in step 3.
ROUTES = 3
BLOCK = 1024
BLOCK_HASHES = 4_000_000
FAN = 8
LEAF = 24
LEADS = 8
WIDEST = 16_384
# Heads that a task looks through at once for hashes it can tell to be shared, and how many of those are sent to all tasks.
HEADS_AT_ONCE = 4096
TOLD = 20_000
CACHE_ROWS = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, known: dict[bytes, int], width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of the shingles of a text. ``known`` keeps the hashes of words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(known) > CACHE_ROWS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w, 7)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) < width:
        whole = np.uint64(len(h)) * np.ones(1, dtype=np.uint64)
        for k in range(len(h)):
            whole = whole * MULTIPLIER + h[k : k + 1]
        return _mixed(whole)
    last = len(h) - width + 1
    value = h[:last]
    for k in range(1, width):
        value = value * MULTIPLIER + h[k : last + k]
    return np.unique(_mixed(value))


def overlap_needed(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` with any set it is linked with."""
    return -(-percent * n // 100)


def shared_in_heads(n: int) -> int:
    """How many hashes of its head a set of ``n``, the smaller of a linked pair, shares with the other head."""
    return max(1, n // SHARE)


def head_size(n: int, percent: int) -> int:
    return min(n, n - overlap_needed(n, percent) + shared_in_heads(n))


def least_shared(n: int, percent: int) -> int:
    """How many head hashes a linked set of ``n`` shares with another head at least; the other one may be smaller."""
    return shared_in_heads(overlap_needed(n, percent))


def signed(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """``id``, ``text_hash``, ``fp`` (of the set, null without a word), ``n`` and ``head``, which a task gives once for each set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        seen: set[int] = set()
        for batch in batches:
            fps, sizes, heads = [], [], []
            for t in batch.column(2).cast(pa.binary()):
                own = shingle_set(t.as_py() or b"", known, width)
                fp = xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63) if len(own) else None
                fps.append(fp)
                sizes.append(len(own))
                heads.append(own[: head_size(len(own), percent)].tobytes() if len(own) and fp not in seen else None)
                seen.add(fp)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(heads, pa.binary())],
                names=["id", "text_hash", "fp", "n", "head"],
            )

    own = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(sign, f"id {own.schema['id'].dataType.simpleString()}, text_hash long, fp long, n long, head binary")


def _heads(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of the heads, and the row of each."""
    parts = [np.frombuffer(h.as_py(), dtype=np.uint64) for h in column]
    return np.concatenate(parts or [np.zeros(0, np.uint64)]), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def told_shared(distinct: DataFrame) -> list[int]:
    """Hashes that a task sees in many heads, the most frequent ``TOLD``: that they are shared needs no grouping, which their many rows would
    make uneven. Which of them are told decides no result."""

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, HEADS_AT_ONCE):
                tokens, rows = _heads(batch.column(0).slice(k, HEADS_AT_ONCE))
                found, n = np.unique(tokens, return_counts=True)
                # Two at least: then they are shared for sure.
                many = n >= max(2, len(np.unique(rows)) // 64)
                yield pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(n[many])], names=["token", "n"])

    counted = distinct.select("head").mapInArrow(often, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return [r["token"] for r in counted.orderBy(F.desc("n"), "token").limit(TOLD).collect()]


def shared_tokens(distinct: DataFrame) -> DataFrame:
    """(fp, token): the head hashes that occur in more than one head."""
    told = distinct.sparkSession.sparkContext.broadcast(np.array(told_shared(distinct), dtype=np.int64))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, HEADS_AT_ONCE):
                part = batch.slice(k, HEADS_AT_ONCE)
                tokens, rows = _heads(part.column(1))
                tokens = tokens.view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(tokens), pa.array(np.isin(tokens, told.value))], names=["fp", "token", "told"])

    entries = distinct.select("fp", "head").mapInArrow(explode, "fp long, token long, told boolean")
    own = Window.partitionBy("token")
    others = entries.where("NOT told").withColumn("_lo", F.min("fp").over(own)).withColumn("_hi", F.max("fp").over(own)).where("_lo < _hi")
    return entries.where("told").select("fp", "token").unionByName(others.select("fp", "token"))


def enough(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``entries`` of sets that have enough of them; ``sets`` has ``fp`` and ``least``."""
    counts = entries.groupBy("fp").agg(F.count("*").alias("_n"))
    kept = counts.join(sets.select("fp", "least"), "fp").where("_n >= least").select("fp")
    return lookup_join(entries, written(kept, "kept"), "fp", "left_semi")


def between(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The ``entries`` whose token occurs in more than one component; ``labels`` has ``fp`` and ``comp``."""
    marked = lookup_join(entries, labels.select("fp", "comp"), "fp")
    tokens = marked.groupBy("token").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("token")
    return lookup_join(entries, written(tokens, "tokens"), "token", "left_semi")


def full_sets(docs: DataFrame, wanted: DataFrame, text: str, width: int) -> DataFrame:
    """``fp``, ``n`` and ``tokens`` (sorted hashes) of the sets ``wanted`` (fp, text_hash), from one of the texts of each."""
    texts = docs.select(F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").alias("text")).where("text is not null")
    own = lookup_join(texts, wanted.select("text_hash"), "text_hash", "left_semi")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        seen: set[int] = set()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                fps, sizes, sets = [], [], []
                for h, t in zip(batch.column(0).slice(k, 512).to_pylist(), batch.column(1).slice(k, 512).cast(pa.binary()), strict=True):
                    if h in seen:
                        continue
                    seen.add(h)
                    tokens = shingle_set(t.as_py(), known, width)
                    if len(tokens):
                        fps.append(xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63))
                        sizes.append(len(tokens))
                        sets.append(tokens.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], names=["fp", "n", "tokens"])

    found = own.select("text_hash", "text").mapInArrow(fill, "fp long, n long, tokens binary")
    return found.dropDuplicates(["fp"])


def width_of(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set of ``n``: a power of two, four a hash or more."""
    return np.minimum(WIDEST, 64 << np.ceil(np.log2(np.maximum(1, n / 16))).astype(np.int64))


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, dtype=bool)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view("<u8")


class Tree:
    """Levels of nodes from the leaves up: least and greatest size, greatest number of hashes above the bits they set, OR of the bitmaps,
    least and greatest component."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, comps: np.ndarray):
        excess = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(sizes, sizes, excess, bits, comps, comps)]
        while len(self.levels[-1][0]) > 1:
            lo, hi, excess, bits, first, last = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            self.levels.append(
                (np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(excess, at), np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at))
            )


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Places of the pairs of nodes (i, j) that may hold a linked pair of two components."""
    lo_a, hi_a, over_a, bits_a, first_a, last_a = a
    lo_b, hi_b, over_b, bits_b, first_b, last_b = b
    near = (100 * hi_b[j] >= percent * lo_a[i]) & (100 * hi_a[i] >= percent * lo_b[j])
    one = (first_a[i] == last_a[i]) & (first_b[j] == last_b[j]) & (first_a[i] == first_b[j])
    kept = np.flatnonzero(near & ~one)
    i, j = i[kept], j[kept]
    common = np.bitwise_count(bits_a[i] & bits_b[j]).sum(axis=1, dtype=np.int64)
    # A shared hash is on a common bit, and beyond one for each bit there are no more than the excess of either.
    most = np.minimum(np.minimum(hi_a[i], hi_b[j]), common + np.minimum(over_a[i], over_b[j]))
    return kept[(100 + percent) * most >= percent * (lo_a[i] + lo_b[j])]


def dual(a: Tree, b: Tree | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves, one of each tree, or of ``a`` alone, that pass the bounds of all their nodes."""
    same = b is None
    b = a if b is None else b
    top = max(len(a.levels), len(b.levels)) - 1
    at = lambda tree, level: tree.levels[min(level, len(tree.levels) - 1)]
    stack = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    step = np.arange(FAN)
    while stack:
        level, i, j = stack.pop()
        if level == 0:
            if len(i):
                yield i, j
            continue
        below_a, below_b = at(a, level - 1), at(b, level - 1)
        # A tree that is not as high has the same single node on all levels above.
        child_a = i[:, None] * FAN + step if level < len(a.levels) else np.where(step == 0, i[:, None], len(below_a[0]))
        child_b = j[:, None] * FAN + step if level < len(b.levels) else np.where(step == 0, j[:, None], len(below_b[0]))
        ci, cj = np.repeat(child_a, FAN, axis=1).ravel(), np.tile(child_b, (1, FAN)).ravel()
        real = (ci < len(below_a[0])) & (cj < len(below_b[0]))
        if same:
            real &= ci < cj if level == 1 else ci <= cj
        ci, cj = ci[real], cj[real]
        chunk = max(256, (1 << 21) // (FAN * FAN * below_a[3].shape[1]))
        for k in range(0, len(ci), chunk):
            kept = _possible(below_a, below_b, ci[k : k + chunk], cj[k : k + chunk], percent) + k
            if len(kept):
                stack.append((level - 1, ci[kept], cj[kept]))


def candidate_pairs(sizes: np.ndarray, bits: list[np.ndarray], comps: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different components that may be linked. Rows of one width of bitmap are one tree; linked sets have equal or neighbouring
    widths, and a bitmap is folded to compare it with a narrower one."""
    widths = width_of(sizes)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        # Close sizes are close by, and in them sets with a common first bit.
        lead = np.array([bits[r][0] for r in rows], dtype=np.uint64)
        rows = rows[np.lexsort((lead & (~lead + np.uint64(1)), (np.log(sizes[rows]) / -np.log(percent / 100)).astype(np.int64)))]
        tree = Tree(sizes[rows], np.stack([bits[r] for r in rows]), comps[rows])
        for i, j in dual(tree, None, percent):
            yield rows[i], rows[j]
        wide = np.flatnonzero((widths == 2 * width) & (percent * sizes <= 100 * sizes[rows].max()))
        if len(wide) and width < WIDEST:
            own = rows[100 * sizes[rows] >= percent * sizes[wide].min()]
            if len(own):
                half = int(width) // 64
                folded = np.stack([bits[r][:half] | bits[r][half:] for r in wide])
                left = Tree(sizes[own], np.stack([bits[r] for r in own]), comps[own])
                for i, j in dual(left, Tree(sizes[wide], folded, comps[wide]), percent):
                    yield own[i], wide[j]


def leaf_pairs(sizes: list[int], bits: list[bytes], comps: list[int], percent: int) -> list[tuple[int, int]]:
    """As :func:`candidate_pairs`, for few sets."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    maps = [int.from_bytes(b, "little") for b in bits]
    over = [n - m.bit_count() for n, m in zip(sizes, maps, strict=True)]
    found = []
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            n, m = sizes[i], sizes[j]
            if percent * m > 100 * n:
                break
            if comps[i] == comps[j]:
                continue
            width, wide, other = 8 * len(bits[i]), maps[j], over[j]
            if len(bits[j]) > len(bits[i]):  # twice as wide
                wide = (wide & ((1 << width) - 1)) | (wide >> width)
                other = m - wide.bit_count()
            most = min(n, (maps[i] & wide).bit_count() + min(over[i], other))
            if (100 + percent) * most >= percent * (n + m):
                found.append((i, j))
    return found


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what the sets' links connect."""
    label = np.arange(len(sets))
    found: list[tuple[int, int]] = []

    def compare(i: int, j: int) -> None:
        if label[i] != label[j] and linked(sets[i], sets[j], percent):
            found.append((i, j))
            label[label == label[j]] = label[i]

    sizes = np.array([len(s) for s in sets])
    # Neighbours by size first: copies with few changes grow together before the tree is made.
    order = np.argsort(sizes, kind="stable")
    for i, j in zip(order[:-1], order[1:], strict=True):
        compare(i, j)
    if (label == label[0]).all():
        return found
    bits = [bitmap(s, int(w)) for s, w in zip(sets, width_of(sizes), strict=True)]
    for i, j in candidate_pairs(sizes, bits, label.copy(), percent):
        open_ = label[i] != label[j]
        for a, b in zip(i[open_].tolist(), j[open_].tolist(), strict=True):
            compare(a, b)
    return found


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each group of equal first columns, which follow one another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and held[-1].column(0)[-1] != part.column(0)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def routed_links(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the sets that share one of their ``ROUTES`` first shared head hashes."""
    first = entries.groupBy("fp").agg(F.slice(F.array_sort(F.collect_list("token")), 1, ROUTES).alias("t"))
    routed = written(first.join(sets.select("fp", "n"), "fp").select("fp", "n", F.explode("t").alias("token")), "routed")
    groups = routed.groupBy("token").agg(F.count("*").alias("_k"), F.sum("n").alias("_h"), F.min("fp").alias("_lo"), F.max("fp").alias("_hi"))
    groups = written(groups.where("_k > 1"), "groups")
    blocks = F.ceil(F.greatest(F.col("_k") / BLOCK, F.col("_h") / BLOCK_HASHES)).cast("int")
    # Other blocks for each token, so that what one deals apart another may bring together.
    own = F.array(F.pmod(F.xxhash64("fp", "token"), blocks).cast("int"))
    outer = (F.col("fp") == F.col("_lo")) | (F.col("fp") == F.col("_hi"))
    dealt = lookup_join(routed, groups, "token").select(
        "fp", "token", F.explode(F.when(outer, F.sequence(F.lit(0), blocks - 1)).otherwise(own)).alias("_block")
    )
    placed = dealt.select(F.xxhash64("token", "_block").alias("g"), "fp").join(sets.select("fp", "tokens"), "fp").select("g", "fp", "tokens")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            fps = group.column("fp").to_pylist()
            own = [np.frombuffer(t.as_py(), dtype=np.uint64) for t in group.column("tokens")]
            yield _pair_batch([(fps[i], fps[j]) for i, j in spanning_links(own, percent)])

    return placed.repartition("g").sortWithinPartitions("g").mapInArrow(link, "a long, b long")


def candidates(entries: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, one_each: bool) -> DataFrame:
    """Pairs (a, b) of sets of different components that may be linked: all, or one for each token and pair of components of which one has
    more than one set.

    A set of which ``least`` head hashes at least are shared with a partner meets it at all its shared hashes but the ``least - 1`` most
    frequent ones.
    """
    often = written(entries.groupBy("token").agg(F.count("*").alias("df")), "frequency")
    ordered = lookup_join(entries, often, "token").groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    many = labels.groupBy("comp").agg((F.count("*") > 1).alias("many"))
    known = sets.select("fp", "n", "least", "bits").join(lookup_join(labels, many, "comp"), "fp")
    kept = F.greatest(F.size("t") - F.col("least") + 1, F.lit(0)).cast("int")
    lead = F.array_sort(F.slice(F.col("t")["token"], 1, LEADS))
    meets = ordered.join(known.select("fp", "least", "many"), "fp").select("fp", "many", lead.alias("lead"), F.slice("t", F.lit(1), kept).alias("t"))
    meets = written(meets, "meets")
    routed = meets.select("fp", "many", F.explode("t").alias("t")).select("fp", "many", "t.token", "t.df")
    if one_each:
        worth = routed.groupBy("token").agg(F.max("many").alias("any")).where("any").select("token")
        routed = lookup_join(routed, written(worth, "worth"), "token", "left_semi")
    blocks = F.ceil(F.col("df") / (4 * BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = (
        routed.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(F.xxhash64("token", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("g"), "fp", "token")
    )
    carried = known.select("fp", "n", "comp", "many", "bits").join(meets.select("fp", "lead"), "fp")
    placed = dealt.join(carried, "fp").select("g", "fp", "token", "n", "comp", "many", "bits", "lead")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in _groups(batches):
            comps = group.column("comp").to_numpy()
            if comps.min() == comps.max():
                continue
            token = group.column("token")[0].as_py()
            fps, many, leads = group.column("fp").to_pylist(), group.column("many").to_pylist(), group.column("lead").to_pylist()
            bits = [b.as_buffer() for b in group.column("bits")]
            seen: set[tuple[int, int]] = set()
            if len(fps) <= LEAF:
                pairs = iter([leaf_pairs(group.column("n").to_pylist(), [bytes(b) for b in bits], comps.tolist(), percent)])
            else:
                trees = candidate_pairs(group.column("n").to_numpy(), [np.frombuffer(b, dtype="<u8") for b in bits], comps, percent)
                pairs = (zip(i.tolist(), j.tolist(), strict=True) for i, j in trees)
            for part in pairs:
                for i, j in part:
                    if comps[i] == comps[j] or one_each and not (many[i] or many[j]):
                        continue
                    both = set(leads[i]).intersection(leads[j])
                    if both and min(both) != token:
                        continue
                    if one_each:
                        named = (min(comps[i], comps[j]), max(comps[i], comps[j]))
                        if named in seen:
                            continue
                        seen.add(named)
                    found.append((min(fps[i], fps[j]), max(fps[i], fps[j])))
                if len(found) > 100_000:
                    yield _pair_batch(found)
                    found = []
        yield _pair_batch(sorted(set(found)))

    return placed.repartition("g").sortWithinPartitions("g").mapInArrow(pair, "a long, b long").distinct()


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(t.as_py(), dtype=np.uint64) for t in batch.column(k)] for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array([linked(p, q, percent) for p, q in zip(x, y, strict=True)], pa.bool_()))

    tokens = sets.select("fp", "tokens")
    left = pairs.join(tokens.select(F.col("fp").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(tokens.select(F.col("fp").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _labels(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``fp`` and ``comp`` of all ``sets``."""
    roots = components(links).withColumnsRenamed({"node": "fp", "root": "comp"})
    return written(sets.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp")), "labels")


def _with_bits(sets: DataFrame) -> DataFrame:
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(t.as_py(), dtype=np.uint64) for t in batch.column(2)]
            widths = width_of(np.array([len(t) for t in tokens]))
            bits = [bitmap(t, int(w)).tobytes() for t, w in zip(tokens, widths, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.binary())], names=["fp", "n", "tokens", "least", "bits"])

    return sets.select("fp", "n", "tokens", "least").mapInArrow(draw, "fp long, n long, tokens binary, least long, bits binary")


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id`` (the ``key``), ``n_shingles`` and ``component_id`` (the smallest ``doc_id`` that links reach) of every row."""
    rows = written(signed(docs, key, text, width, percent), "signed")
    real = rows.where("fp is not null")
    distinct = real.groupBy("fp").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.max("head").alias("head"), F.min("text_hash").alias("text_hash"))
    distinct = written(distinct, "distinct")
    # As ``least_shared``.
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / SHARE)).cast("long")
    measured = distinct.select("fp", "n", "text_hash", least.alias("least"))
    # What two rounds of counting leave.
    entries = written(enough(shared_tokens(distinct), measured), "entries")
    alone = distinct.select("fp", F.col("fp").alias("comp"))
    entries = written(enough(between(entries, alone), measured), "entries")
    wanted = written(entries.select("fp").distinct().join(measured, "fp"), "wanted")
    sets = full_sets(docs, wanted, text, width).join(wanted.select("fp", "least"), "fp")
    sets = written(_with_bits(sets), "sets")

    links = written(routed_links(entries, sets, percent), "links")
    for one_each in (True, False):
        labels = _labels(sets, links)
        entries = written(enough(between(entries, labels), measured), "entries")
        more = compared(candidates(entries, sets, labels, percent, one_each), sets, percent)
        links = written(links.unionByName(more), "links")
    labels = _labels(sets, links)
    classes = distinct.select("fp", "first").join(labels, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    smallest = classes.groupBy("comp").agg(F.min("first").alias("component_id"))
    found = written(lookup_join(classes, smallest, "comp").select("fp", "component_id"), "classes")
    linked_rows = lookup_join(real.select("id", "fp", "n"), found, "fp").select("id", "n", "component_id")
    single = rows.where("fp is null").select("id", "n", F.col("id").alias("component_id"))
    return linked_rows.unionByName(single).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
