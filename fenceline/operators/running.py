"""Running sums and positions without one task per sequence or per table.

The order column is cut into cells. Cell totals are aggregated first (map-side), the running
sum over whole cells sees one row per cell, and rows are only ordered inside their cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import literal_array, written

# Rows of a sequence ordered in one task.
CELL = 4096
# A whole table is cut into at most FAN * FAN cells of about equal size.
FAN = 64


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, out: str, cell: int = CELL) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the preceding rows of the key, in ``order`` (an
    integer, unique per key)."""
    return _running(df, keys, order, value, out, F.floor(F.col(order) / cell))


def position(df: DataFrame, keys: list[str], order: str, out: str = "pos", cell: int = CELL) -> DataFrame:
    """Add the 0-based dense position of a row within its key."""
    return running_sum(df, keys, order, F.lit(1), out, cell)


def batches(df: DataFrame, order: str, size: int, fan: int = FAN) -> DataFrame:
    """Add ``idx`` (0-based dense index over the table) and ``batch_id`` (``size`` rows each).

    ``order`` is an integer column, unique over the table. Approximate quantiles cut it into cells of
    about equal size, whatever its distribution; the cell is a function of the value alone, so a
    recomputed task assigns the same index.
    """
    steps = literal_array([i / fan**2 for i in range(fan**2)], "array<double>")
    bounds = df.agg(F.percentile_approx(order, steps, 10 * fan**2)).first()[0] or [0]
    indexed = _running(df, [], order, F.lit(1), "idx", _cell(F.col(order), sorted(set(bounds)), fan))
    return indexed.withColumn("batch_id", F.floor(F.col("idx") / size))


def batches_by(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """As :func:`batches`, in the order of any columns, ties included."""
    return numbered(df, order).withColumn("batch_id", F.floor(F.col("idx") / size))


def numbered(df: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """Add ``out``: the 0-based dense place of a row in the order of any columns; equal rows follow one another in any order.

    The rows are dealt into ranges of the order, as many as there are shuffle partitions, sorted inside each and written with their place in it; the ranges' sizes, summed
    up, give each its first number. Rows that agree in the order may lie in several ranges.
    """
    # The row's number in the input tells equal rows apart, so that a frequent key is no single range. It is fixed by writing it: a task
    # that is run again must deal its rows out as before.
    told = written(df.withColumn("_tie", F.monotonically_increasing_id()), "told")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = told.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    # The id counts the rows of a partition from its number shifted by 33 bits.
    rows = written(ranges.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    own = F.shiftright("_at", 33)
    sizes = rows.groupBy(own.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per range.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    placed = rows.withColumn("_part", own).join(F.broadcast(first), "_part")
    return placed.withColumn(out, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_first")


def _cell(value: Column, bounds: list[int], fan: int) -> Column:
    """Number of bounds up to ``value``, found in a group of bounds and then inside the group."""
    groups = [bounds[i : i + fan] for i in range(0, len(bounds), fan)]
    firsts = literal_array([g[0] for g in groups], "array<bigint>")
    members = literal_array(groups, "array<array<bigint>>")
    group = F.greatest(F.size(F.filter(firsts, lambda b: b <= value)), F.lit(1))
    inside = F.size(F.filter(F.element_at(members, group), lambda b: b <= value))
    return group * fan + inside


def _running(df: DataFrame, keys: list[str], order: str, value: Column, out: str, cell: Column) -> DataFrame:
    rows = df.withColumn("_cell", cell).withColumn("_v", value.cast("bigint"))
    totals = rows.groupBy(*keys, "_cell").agg(F.sum("_v").alias("_t"))
    if keys:
        over_cells = Window.partitionBy(*keys).orderBy("_cell")
    else:
        # One row per cell of the table, at most FAN * FAN + 1 of them.
        over_cells = Window.orderBy("_cell")
    over_cells = over_cells.rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, "_cell", F.coalesce(F.sum("_t").over(over_cells), F.lit(0)).alias("_base"))
    if not keys:
        bases = F.broadcast(bases)
    inside = Window.partitionBy(*keys, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("_v").over(inside), F.lit(0))
    return (
        rows.withColumn("_in", within)
        .join(bases, [*keys, "_cell"])
        .withColumn(out, F.col("_base") + F.col("_in"))
        .drop("_cell", "_v", "_in", "_base")
    )
