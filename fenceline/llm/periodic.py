"""Periodic runs of words, found on a grammar that Re-Pair makes of the word ids.

A run is a longest stretch of consecutive words with smallest period q whose length is at least
``TIMES`` * q and ``SHORTEST``.

1. Every pair of neighbours inside a run occurs at least three times in it. Pairs that are rarer in their stretch are
   cut, and what is left of a text is counted and cut again; plain prose falls apart and needs no grammar.
2. Re-Pair over the stretches of many texts at once, in rounds: pairs are ranked by how often they occur, and a pair gives
   way to a nonterminal wherever neither neighbouring pair ranks higher. No pair is left that occurs twice; the rest
   of each stretch is halved evenly.
3. A nonterminal is taken once, where it first occurs. Runs inside it that cross the border of its two parts have a
   square on one side of the border. Squares are found by names: equal numbers for equal strings of 2^k words, so that
   the longest common extension of two places takes one step per k.
4. Each run of a nonterminal is translated to all places where the nonterminal was derived, and intervals of one period that
   share a period or more are merged. A run of the text lies whole in the lowest node that contains
   it and crosses that node's border, so all are found.

A task works on one slice of texts at a time (``SLICE_WORDS``, or one text): about 100 bytes a word, and
4 * log2(length) more for words in stretches that may be periodic. Nothing is shuffled.

Null and empty texts have no words and no runs. A null ``doc_id`` is never changed by ``looped``. Repeated rows are treated one by one.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORTEST = 6
TIMES = 4
SLICE_WORDS = 500_000
NO_RUN = sha256(b"").hexdigest()


def looped(key: object, n: int) -> tuple[int, int] | None:
    """Of the texts whose id's crc32 ends in 0: from word a on, word i is the original word a + (i - a) % p."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that may lie in a run, and the number of the stretch of each.

    Pairs are counted in a table by hash; two that share a cell only make the cut less sharp.
    """
    places, own = np.arange(len(ids)), owner
    while len(places):
        word = ids[places]
        same = own[1:] == own[:-1]
        h = _mixed(word[:-1] * np.int64(0x1F123BB5) + word[1:] * np.int64(0x5851F42D4C957F2D) + own[:-1] * np.int64(0x14057B7EF767814F))
        cells = 1 << max(10, (4 * len(places)).bit_length())
        cell = (h & np.uint64(cells - 1)).astype(np.int64)
        kept = same & (np.bincount(cell[same], minlength=cells)[cell] >= 3)
        first = np.r_[True, ~kept]
        number = np.cumsum(first) - 1
        stays = np.bincount(number)[number] >= SHORTEST
        before = len(places)
        places, own = places[stays], number[stays]
        if len(places) > 0.9 * before:
            break
    return places, own


class Grammar:
    """Re-Pair over ``word`` within the stretches ``own``: nodes by their first place, and all places of each."""

    def __init__(self, word: np.ndarray, own: np.ndarray):
        symbol = np.unique(word, return_inverse=True)[1].astype(np.int64)
        at, size = np.arange(len(word)), np.ones(len(word), dtype=np.int64)
        top = int(symbol.max()) + 1 if len(symbol) else 0
        starts, mids, ends, nodes, places = [], [], [], [], []
        count, halving = 0, False
        while True:
            same = own[1:] == own[:-1]
            if not same.any():
                break
            rank = np.full(len(same), -1)
            if not halving:
                pairs, which, often = np.unique(symbol[:-1][same] * top + symbol[1:][same], return_inverse=True, return_counts=True)
                halving = often.max() < 2
            if halving:
                rank[same] = 0
            else:
                order = np.empty(len(pairs), dtype=np.int64)
                order[np.lexsort((_mixed(pairs), often))] = np.arange(len(pairs))
                rank[same] = np.where(often[which] > 1, order[which], -1)
            # Equal neighbours are one pair that overlaps itself (or a stretch that is halved): every second one.
            head = np.r_[True, rank[1:] != rank[:-1]]
            offset = np.arange(len(rank)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            left, right = np.r_[-1, rank[:-1]], np.r_[rank[1:], -1]
            won = np.flatnonzero((rank >= 0) & (rank >= left) & (rank >= right) & (offset % 2 == 0))
            if halving:
                first, new = np.arange(len(won)), np.arange(len(won))
            else:
                _, first, new = np.unique(rank[won], return_index=True, return_inverse=True)
            f = won[first]
            starts.append(at[f])
            mids.append(at[f + 1])
            ends.append(at[f + 1] + size[f + 1])
            nodes.append(count + new)
            places.append(at[won])
            symbol[won] = top + new
            size[won] += size[won + 1]
            count, top = count + len(first), top + len(first)
            stay = np.ones(len(symbol), dtype=bool)
            stay[won + 1] = False
            symbol, own, at, size = symbol[stay], own[stay], at[stay], size[stay]
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        self.start, self.mid, self.end = join(starts), join(mids), join(ends)
        self.node, self.place = join(nodes), join(places)


class Names:
    """For each k, equal numbers for equal strings of 2^k words inside the stretches."""

    def __init__(self, word: np.ndarray, own: np.ndarray):
        n = len(word)
        sizes = np.bincount(own)
        end = np.repeat(np.cumsum(sizes), sizes)
        self.n, self.of = n, [np.unique(word, return_inverse=True)[1].astype(np.int32)]
        here = np.arange(n)
        while True:
            k = len(self.of) - 1
            now = self.of[k]
            longer = np.flatnonzero(here + (2 << k) <= end)
            if not len(longer):
                return
            both = now[longer].astype(np.int64) * n + now[longer + (1 << k)]
            names = np.full(n, -1, dtype=np.int32)
            names[longer] = np.unique(both, return_inverse=True)[1]
            self.of.append(names)

    def in_order(self, k: int) -> np.ndarray:
        """name * n + place of all strings of 2^k words, sorted. Made when it is needed: it takes more room than the names."""
        real = np.flatnonzero(self.of[k] >= 0)
        return np.sort(self.of[k][real].astype(np.int64) * self.n + real)

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and ``b`` on agree, ``most`` at most (``most`` stays inside a stretch)."""
        same = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.of) - 1, -1, -1):
            open_ = np.flatnonzero(same + (1 << k) <= most)
            agree = open_[self.of[k][a[open_] + same[open_]] == self.of[k][b[open_] + same[open_]]]
            same[agree] += 1 << k
        return same

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same for the words before ``a`` and ``b``."""
        same = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.of) - 1, -1, -1):
            open_ = np.flatnonzero(same + (1 << k) <= most)
            agree = open_[self.of[k][a[open_] - same[open_] - (1 << k)] == self.of[k][b[open_] - same[open_] - (1 << k)]]
            same[agree] += 1 << k
        return same

    def squares(self, mid: np.ndarray, room: np.ndarray, most: np.ndarray, ahead: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Squares that begin (``ahead``) or end at ``mid`` with a root of at most ``most`` words, whose roots are no powers: the row, the root's length, and how
        far the period goes on after the first root. ``room``: words on that side.

        After a root of q words whose period holds for q + x words, no root of x words or fewer is left that is no power.
        """
        least = np.ones(len(mid), dtype=np.int64)
        rows, roots, more = ([np.zeros(0, dtype=np.int64)] for _ in range(3))
        for k in range(len(self.of)):
            at = np.flatnonzero((2 << k <= room) & (1 << k <= most))
            if not len(at):
                break
            q, in_order = np.maximum(least[at], 1 << k), self.in_order(k)
            while len(at):
                place = mid[at] if ahead else mid[at] - (1 << k)
                name = self.of[k][place].astype(np.int64)
                if ahead:
                    next_ = np.searchsorted(in_order, name * self.n + place + q)
                    found = in_order[np.minimum(next_, len(in_order) - 1)]
                    q = found - name * self.n - place
                    ok = (next_ < len(in_order)) & (found // self.n == name)
                else:
                    next_ = np.searchsorted(in_order, name * self.n + place - q, side="right") - 1
                    found = in_order[np.maximum(next_, 0)]
                    q = name * self.n + place - found
                    ok = (next_ >= 0) & (found // self.n == name) & (place >= q)
                ok &= (q < 2 << k) & (2 * q <= room[at]) & (q <= most[at])
                at, q = at[ok], q[ok]
                if ahead:
                    on = self.forward(mid[at], mid[at] + q, room[at] - q)
                else:
                    on = self.backward(mid[at], mid[at] - q, room[at] - q)
                good = on >= q
                rows.append(at[good])
                roots.append(q[good])
                more.append(on[good])
                least[at[good]] = np.maximum(least[at[good]], on[good] + 1)
                q = np.maximum(q + 1, least[at])
        return np.concatenate(rows), np.concatenate(roots), np.concatenate(more)


def runs(word: np.ndarray, own: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, place after the last, and period of every run in ``word``, none across stretches ``own`` (numbered from 0, in order)."""
    none = np.zeros(0, dtype=np.int64)
    grammar = Grammar(word, own)
    long_ = np.flatnonzero(grammar.end - grammar.start >= shortest)
    if not len(long_):
        return none, none, none
    names = Names(word, own)
    start, mid, end = grammar.start[long_], grammar.mid[long_], grammar.end[long_]
    most = (end - start) // times
    row, q, on = names.squares(mid, end - mid, most, ahead=True)
    stop = mid[row] + q + on
    begin = mid[row] - names.backward(mid[row], mid[row] + q, (mid - start)[row])
    row_, q_, on_ = names.squares(mid, mid - start, most, ahead=False)
    begin_ = mid[row_] - q_ - on_
    stop_ = mid[row_] + names.forward(mid[row_] - q_, mid[row_], (end - mid)[row_])
    row, q, begin, stop = (np.concatenate(x) for x in ((row, row_), (q, q_), (begin, begin_), (stop, stop_)))
    crossing = (begin < mid[row]) & (stop > mid[row]) & (stop - begin >= np.maximum(shortest, times * q))
    row, q, begin, stop = (x[crossing] for x in (row, q, begin, stop))
    order = np.argsort(row, kind="stable")
    row, q, begin, stop = (x[order] for x in (row, q, begin, stop))

    # To all places of the nodes.
    number = np.full(len(grammar.start), -1)
    number[long_] = np.arange(len(long_))
    node = number[grammar.node]
    first, last = np.searchsorted(row, node, "left"), np.searchsorted(row, node, "right")
    times_ = np.where(node >= 0, last - first, 0)
    which = np.repeat(first - np.r_[0, np.cumsum(times_)[:-1]], times_) + np.arange(times_.sum())
    shift = np.repeat(grammar.place, times_) - start[row[which]]
    q, begin, stop = q[which], begin[which] + shift, stop[which] + shift

    # Intervals of one period that share at least a period are one.
    order = np.lexsort((begin, q))
    q, begin, stop = q[order], begin[order], stop[order]
    if not len(q):
        return none, none, none
    group = np.cumsum(np.r_[False, q[1:] != q[:-1]]) * np.int64(2 * len(word) + 2)
    reach = np.maximum.accumulate(stop + group)
    fresh = np.r_[True, (begin + group)[1:] > reach[:-1] - q[1:]]
    heads = np.flatnonzero(fresh)
    return begin[heads], (reach - group)[np.r_[heads[1:] - 1, len(q) - 1]], q[heads]


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of word ids, by start, then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return found
    ids = np.concatenate(texts).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    places, own = stretches(ids, owner)
    if not len(places):
        return found
    own = np.cumsum(np.r_[False, own[1:] != own[:-1]])
    begin, stop, q = runs(ids[places], own)
    at = places[begin]
    first = np.cumsum(sizes) - sizes
    order = np.lexsort((q, at))
    for d, a, n, p in zip(owner[at[order]].tolist(), at[order].tolist(), (stop - begin)[order].tolist(), q[order].tolist(), strict=True):
        found[d].append((a - int(first[d]), n, p))
    return found


def _result(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    if not found:
        return 0, None, None, None, None, NO_RUN, sha256(b" ".join(words)).hexdigest()
    best = found[0]
    for x in found[1:]:
        # By start, then period: only a greater one replaces an earlier one.
        if x[1] * best[2] > best[1] * x[2]:
            best = x
    lines = "".join(f"{a},{n},{p}\n" for a, n, p in found)
    kept, at = [], 0
    for a, b in sorted((a + p, a + n) for a, n, p in found):
        if b > at:
            kept += words[at : max(a, at)]
            at = b
    kept += words[at:]
    return len(found), *best, 1000 * best[1] // best[2], sha256(lines.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest()


def detected(docs: DataFrame, key: str = "doc_id", text: str = "text", change: Callable[[object, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """The ``key``, ``n_runs``, the run of greatest exponent (``start``, ``length``, ``period``, ``exponent_milli``),
    ``runs_sha256`` and ``collapsed_sha256`` of every row. ``change`` may loop the words of a text first."""
    columns = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            texts = batch.column(1).cast(pa.binary())
            first = 0
            while first < batch.num_rows:
                number: defaultdict[bytes, int] = defaultdict()
                number.default_factory = number.__len__
                words, ids, total, last = [], [], 0, first
                while last < batch.num_rows and total < SLICE_WORDS:
                    own = (texts[last].as_py() or b"").split()
                    numbers = np.fromiter(map(number.__getitem__, own), dtype=np.int64, count=len(own))
                    if change and (loop := change(keys[last].as_py(), len(own))):
                        a, p = loop
                        from_ = np.arange(len(own))
                        from_[a:] = a + (from_[a:] - a) % p
                        own, numbers = [own[i] for i in from_.tolist()], numbers[from_]
                    words.append(own)
                    ids.append(numbers)
                    total, last = total + len(own), last + 1
                rows = [_result(w, f) for w, f in zip(words, runs_of(ids), strict=True)]
                values = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), columns.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(first, last - first), *values], names=[batch.schema.names[0], *columns])
                first = last

    own = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text"))
    kind = own.schema.fields[0].dataType.simpleString()
    return own.mapInArrow(detect, f"`{key}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
