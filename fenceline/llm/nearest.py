"""Approximate nearest neighbours by cosine: inverted lists and an adaptive scan over blocks of dimensions.

Vectors are scaled to length 1, so the nearest by cosine are the nearest by distance, and rotated by one random
orthogonal matrix, after which any prefix of dimensions estimates the whole distance. k-means on a
bounded sample (``FIT_ROWS`` rows and ``FIT_BYTES`` at most, those with the smallest hashes of their ids) gives the lists; every vector is put into
the list of its nearest centre, every query looks into the ``probes`` lists with the nearest ones. Their number is
fitted on the same sample for a recall of ``TARGET``.

Inside a list, vectors lie in column blocks. The scan adds up the distance block by block; after d of D dimensions a
candidate is abandoned if a hypothesis test says that its full distance exceeds the current k-th best:
partial * D / d > (1 + epsilon / sqrt(d))^2 * best. Those that reach the last block are ranked by their exact
cosine, in double precision, on the original vectors.

A list of any length is dealt into parts of about ``PART_ROWS`` vectors, its queries into parts as well; a task scans one
part against one part and returns k rows per query. Queries that find fewer than k rows, although
there are more vectors, look into all lists.

Vectors that are null, empty, of another length than most, zero, or that hold null or non-finite components take no part, nor do
rows with a null id. Equal scores are ordered by id. Every row has a number of its own: rows with one id, and equal rows, are
separate queries and candidates of one another; only the row itself is left out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

FIT_ROWS = 20_000
FIT_BYTES = 64_000_000
MOST_LISTS = 4_096
PART_ROWS = 8_192
QUERY_PART_ROWS = 1_024
BLOCK = 16
EPSILON = 2.1
ROUNDS = 8
SEED = 7
# Recall that the number of probed lists aims at, and the rows that it is measured with.
TARGET = 0.97
TRIED = 500


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part."""
    own = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    nonzero = F.exists("v", lambda x: x != 0)
    return own.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & nonzero)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that no square overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """k-means on distinct rows of unit vectors; a centre that loses all rows keeps its place."""
    sample = np.unique(sample, axis=0)
    found = sample[np.random.default_rng(seed).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        sums, counts = np.zeros_like(found), np.zeros(len(found))
        for k in range(0, len(sample), 4096):
            part = sample[k : k + 4096]
            at = nearest_centres(part, found, 1)[:, 0]
            np.add.at(sums, at, part)
            counts += np.bincount(at, minlength=len(found))
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


def nearest_centres(v: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first."""
    d = (c * c).sum(axis=1)[None, :] - 2 * (v @ c.T)
    n = min(n, len(c))
    at = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, axis=1), axis=1, kind="stable"), axis=1)


def probes_for(sample: np.ndarray, centre: np.ndarray, k: int, target: float = TARGET) -> int:
    """The fewest lists to look into that hold ``target`` of the k nearest rows, as measured between
    at most ``TRIED`` rows and all rows of the sample."""
    own = nearest_centres(sample, centre, 1)[:, 0]
    tried = np.unique(np.linspace(0, len(sample) - 1, TRIED).astype(int))
    places = []
    for at in tried:
        score = sample @ sample[at]
        score[at] = -np.inf
        near = np.argpartition(-score, min(k, len(score) - 1))[:k]
        order = np.empty(len(centre), int)
        order[nearest_centres(sample[at][None], centre, len(centre))[0]] = np.arange(len(centre))
        places.append(order[own[near]])
    return int(np.quantile(np.concatenate(places), target, method="higher")) + 1


def scan(blocks: list[np.ndarray], own: np.ndarray, ids: np.ndarray, v: np.ndarray, query: np.ndarray, query_row: int, q: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """The places and cosines of the ``k`` best rows of a list for one query.

    ``own`` are the rows' numbers, ``blocks`` the rotated unit vectors by blocks of dimensions, ``query`` the rotated query, ``v`` and ``q``
    the original vectors.
    """
    rows = np.flatnonzero(own != query_row)
    size = sum(b.shape[1] for b in blocks)
    partial = np.zeros(len(rows))
    best, d = np.inf, 0
    for n, block in enumerate(blocks):
        diff = block[rows] - query[d : d + block.shape[1]]
        partial = partial + np.einsum("ij,ij->i", diff, diff)
        d += block.shape[1]
        if n == 0 and len(rows) > k:
            # The k most promising rows are measured in full: the first threshold.
            first = rows[np.argpartition(partial, k - 1)[:k]]
            best = sum(np.einsum("ij,ij->i", x, x) for x in _differences(blocks, first, query)).max()
        if d < size and len(rows) > k:
            stay = partial * (size / d) <= (1 + epsilon / np.sqrt(d)) ** 2 * best
            rows, partial = rows[stay], partial[stay]
    if len(rows) > k:
        # Ties at the k-th place stay for the exact ranking.
        kth = np.partition(partial, k - 1)[k - 1]
        rows = rows[partial <= kth + 1e-9]
    score = cosines(v[rows], q)
    order = np.lexsort((ids[rows], -score))[:k]
    return rows[order], score[order]


def _differences(blocks: list[np.ndarray], rows: np.ndarray, query: np.ndarray) -> Iterator[np.ndarray]:
    d = 0
    for block in blocks:
        yield block[rows] - query[d : d + block.shape[1]]
        d += block.shape[1]


def cosines(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row with one order of summation, so that equal vectors have equal scores; at most 1."""
    scaled, own = v / np.abs(v).max(axis=1, keepdims=True), q / np.abs(q).max()
    dots = (scaled * own).sum(axis=1)
    return dots / (np.sqrt((scaled * scaled).sum(axis=1)) * np.sqrt((own * own).sum()))


def searched(vectors: DataFrame, queries: str, k: int = 5, probes: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` nearest rows found for each row that meets
    the condition ``queries`` over ``id``."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    # The numbers of the rows are fixed by writing them.
    every = written(usable(vectors, key, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    width = every.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return spark.createDataFrame([], schema)
    every, rows = every.where(F.size("v") == width["n"]), width["count"]
    sample = every.orderBy(F.xxhash64("id"), "id").select("v").limit(max(1, min(FIT_ROWS, FIT_BYTES // (8 * width["n"])))).toArrow()["v"].combine_chunks()
    lists = int(min(MOST_LISTS, max(1, round(rows**0.5 / 2))))
    turn = rotation(width["n"])
    fitted = unit(sample.flatten().to_numpy().reshape(-1, width["n"])) @ turn
    centre = centres(fitted, lists)
    probes = probes_for(fitted, centre, k) if probes is None else probes
    shared = spark.sparkContext.broadcast((turn, centre))
    parts = max(1, -(-rows // PART_ROWS))

    def assigned(n: int):
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, c = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    v = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    lists_ = nearest_centres(unit(v) @ matrix, c, n)
                    again = pa.array(np.repeat(np.arange(part.num_rows), lists_.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(again) for c in part.columns), pa.array(lists_.ravel().astype("i4"))], names=["row", "id", "v", "list"]
                    )

        return assign

    listed = "row long, id long, v array<double>, list int"
    indexed = written(every.select("row", "id", "v").mapInArrow(assigned(1), listed), "lists")
    sizes = indexed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(PART_ROWS)).cast("int").alias("_parts"))

    def found(asking: DataFrame, n: int) -> DataFrame:
        """Of each query the k best rows of its ``n`` lists."""
        asked = asking.select("row", "id", "v").mapInArrow(assigned(n), listed)
        # Parts are numbered by hash: as many of vectors as the list needs, as many of queries as there may be.
        ask_parts = F.lit(max(1, -(-(rows // 50) * n // (len(centre) * QUERY_PART_ROWS))))
        small = F.broadcast(sizes)  # a row per list: MOST_LISTS at most
        left = (
            indexed.join(small, "list")
            .withColumn("part", F.pmod(F.xxhash64("row"), F.col("_parts")).cast("int"))
            .withColumn("ask", F.explode(F.sequence(F.lit(0), ask_parts - 1)))
        )
        right = (
            asked.join(small, "list")
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
            .withColumn("ask", F.pmod(F.xxhash64("row"), ask_parts).cast("int"))
        )

        def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}).astype({"query_row": "i8", "query_id": "i8", "vec_id": "i8"})
            matrix, _ = shared.value
            v, q = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
            turned, asked_, own, ids = unit(v) @ matrix, unit(q) @ matrix, a["row"].to_numpy(), a["id"].to_numpy()
            blocks = [np.ascontiguousarray(turned[:, d : d + BLOCK]) for d in range(0, v.shape[1], BLOCK)]
            out = [scan(blocks, own, ids, v, asked_[j], r, q[j], k) for j, r in enumerate(b["row"].to_numpy())]
            times = [len(o[0]) for o in out]
            return pd.DataFrame(
                {
                    "query_row": np.repeat(b["row"].to_numpy(), times),
                    "query_id": np.repeat(b["id"].to_numpy(), times),
                    "vec_id": ids[np.concatenate([o[0] for o in out])],
                    "score": np.concatenate([o[1] for o in out]),
                }
            )

        keys = ["list", "part", "ask"]
        hits = left.select(*keys, "row", "id", "v").groupBy(*keys).cogroup(right.select(*keys, "row", "id", "v").groupBy(*keys))
        return hits.applyInPandas(search, "query_row long, query_id long, vec_id long, score double")

    def ranked(hits: DataFrame) -> DataFrame:
        order = "row_number() over (partition by query_row order by score desc, vec_id)"
        return hits.withColumn("rank", F.expr(order)).where(F.col("rank") <= k)

    columns = ["query_id", "rank", "vec_id", "score"]
    asking = every.where(queries)
    if probes >= len(centre):
        return ranked(found(asking, len(centre))).select(columns)
    near = written(ranked(found(asking, probes)), "near")
    enough = near.where(F.col("rank") == min(k, rows - 1)).select(F.col("query_row").alias("row"))
    short = written(asking.join(enough, "row", "left_anti"), "short")
    if short.isEmpty():
        return near.select(columns)
    rest = ranked(found(short, len(centre)))
    return near.join(short.select(F.col("row").alias("query_row")), "query_row", "left_anti").select(columns).unionByName(rest.select(columns))
