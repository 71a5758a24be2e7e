"""Resharding with the fewest moved bytes, as a minimum-cost flow from old shards to new capacities.

1. Documents lie in old shards. Each old shard is dealt into blocks by a hash, so many that a block has
   about ``BLOCK_ROWS`` rows; only the blocks' sizes are summed.
2. ``flows`` solves the transfer problem on the driver: old shards supply their sizes, new shards take
   theirs, a byte that changes its shard costs 1. Its size is old times new shards, both parameters.
3. An old shard's flows are consecutive ranges of its running bytes, the stay first. Blocks that lie inside
   one range move whole; only blocks on a border are split, between documents.
4. ``resharded`` gives each row its new shard and slot, ``affected`` the new shards whose files change, and
   ``rewrite`` writes those alone.

The law is ``bytes``: shard sizes differ by about one document. A null text has no bytes; every row
counts eight bytes beside its text. Repeated rows are placed one by one; an empty table gives an empty result; other columns
are carried along.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless, packed

BLOCK_ROWS = 2_000
ROW_BYTES = 8


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def capacities(total: int, shards: int) -> list[int]:
    """Equal sizes that add up to ``total``."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def flows(supply: list[int], demand: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j that meet both sides at the least cost, where staying
    (i = j) is free and moving costs 1 a byte: shortest augmenting paths with potentials."""
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def edge(a: int, b: int, c: int, w: int) -> None:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            room.append(z)
            cost.append(v)

    for i in range(n):
        edge(source, i, supply[i], 0)
        for j in range(m):
            edge(i, n + j, supply[i], int(i != j))
    for j in range(m):
        edge(n + j, sink, demand[j], 0)
    price = [0] * len(graph)
    while True:
        best = [float("inf")] * len(graph)
        via = [-1] * len(graph)
        best[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            for e in graph[a]:
                if room[e] and d + cost[e] + price[a] - price[to[e]] < best[to[e]]:
                    best[to[e]] = d + cost[e] + price[a] - price[to[e]]
                    via[to[e]] = e
                    heapq.heappush(heap, (best[to[e]], to[e]))
        if via[sink] < 0:
            break
        price = [p + int(d) if d < float("inf") else p for p, d in zip(price, best, strict=True)]
        path, a = [], sink
        while a != source:
            path.append(via[a])
            a = to[via[a] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return {(i, to[e] - n): room[e ^ 1] for i in range(n) for e in graph[i] if n <= to[e] < n + m and room[e ^ 1]}


def resharded(docs: DataFrame, old_shard: Column, old_shards: int, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row``, ``size``, ``text_crc32``, ``old_shard``, ``shard`` and ``slot`` of every row.

    ``old_shard`` is a column over ``docs`` with numbers from 0 to ``old_shards`` - 1.
    """
    spark = docs.sparkSession
    own = docs.withColumn("_old_shard_", old_shard.cast("int"))
    own = packed(own).select(
        F.col("row").dropFields("_old_shard_").alias("row"),
        F.col("row._old_shard_").alias("old_shard"),
        row_size(F.col(f"row.`{text}`")).alias("size"),
        F.crc32(F.coalesce(F.col(f"row.`{text}`"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    tie = F.xxhash64(F.col(f"row.`{key}`"), "size", "text_crc32")
    totals = {r["old_shard"]: r for r in own.groupBy("old_shard").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    supply = [totals[i]["s"] if i in totals else 0 for i in range(old_shards)]
    rows = sum(r["n"] for r in totals.values())
    blocks = max(1, -(-rows // BLOCK_ROWS))
    moves = flows(supply, capacities(sum(supply), shards))
    ranges = []
    for i in range(old_shards):
        targets = sorted((j for a, j in moves if a == i), key=lambda j: (j != i, j))
        ends = list(accumulate(moves[i, j] for j in targets))
        ranges += [(i, a, b, j) for a, b, j in zip([0, *ends], ends, targets, strict=False)]
    plan = spark.createDataFrame(ranges, "old_shard int, _from long, _to long, shard int")
    dealt = own.withColumn("_tie", tie).withColumn("_block", F.pmod(F.shiftrightunsigned("_tie", 20), F.lit(blocks)).cast("int"))
    sizes = dealt.groupBy("old_shard", "_block").agg(F.sum("size").alias("_bytes"))
    first = sizes.selectExpr("old_shard", "_block", "sum(_bytes) over (partition by old_shard order by _block) - _bytes as _first")
    # The place of a row's middle byte in its old shard; ranges cut between rows.
    before = "_first + sum(size) over (partition by old_shard, _block order by _tie, size, text_crc32 rows unbounded preceding) - size"
    placed = dealt.join(first, ["old_shard", "_block"]).withColumn("_at", F.expr(f"{before} + size div 2"))
    # The plan has at most old plus new shards rows.
    sharded = placed.join(F.broadcast(plan), "old_shard").where("_at >= _from and _at < _to").drop("_block", "_first", "_at", "_from", "_to")
    return gapless(sharded, ["shard"], ["_tie", "size", "text_crc32"], "slot", rows).select(
        "row", "size", "text_crc32", "old_shard", "shard", "slot"
    )


def affected(resharded_: DataFrame) -> DataFrame:
    """New shards that take rows from elsewhere or lose rows: ``shard``, ``n_in``, ``n_out``, ``bytes_in``."""
    moved = resharded_.where("old_shard <> shard")
    into = moved.groupBy("shard").agg(F.count("*").alias("n_in"), F.sum("size").alias("bytes_in"))
    out = moved.groupBy(F.col("old_shard").alias("shard")).agg(F.count("*").alias("n_out"))
    return into.join(out, "shard", "full").na.fill(0)


def rewrite(resharded_: DataFrame, path: str) -> None:
    """Write the rows of the affected shards, in slot order, below ``path`` by shard; the files of the others stay."""
    changed = [r["shard"] for r in affected(resharded_).collect()]  # at most old plus new shards
    rows = resharded_.where(F.col("shard").isin(changed))
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("shard", "slot", "row.*").write.partitionBy("shard").parquet(path)
