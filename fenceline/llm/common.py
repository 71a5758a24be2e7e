"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one cell of a two-level rank: what one task has to sort.
CELL_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as one struct column ``row``: an operator's own columns cannot clash."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))


def body(text: str = "text") -> Column:
    """The text of a packed row; a null is an empty text."""
    return F.coalesce(F.col(f"row.`{text}`"), F.lit(""))


def gapless(df: DataFrame, group: list[str], order: list[str], rank: str, rows: int) -> DataFrame:
    """``df`` with ``rank``, the place (from 0) of each row within its group, however large the group is.

    The rows of a group are dealt into cells by the hash of ``order``; a cell is sorted by one task, and the cells' sizes,
    summed up in order, give each cell its first rank. ``rows`` (the rows of ``df``) sets how many
    cells there are. Rows that agree in ``order`` are told apart arbitrarily.
    """
    cells = max(1, -(-rows // CELL_ROWS))
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    sizes = dealt.groupBy(*group, "_cell").agg(F.count("*").alias("_n"))
    keys = ", ".join(f"`{g}`" for g in group)
    first = sizes.selectExpr(
        *[f"`{g}`" for g in group],
        "_cell",
        f"sum(_n) over (partition by {keys} order by _cell) - _n as _first",
    )
    names = ", ".join(f"`{c}`" for c in order)
    return (
        dealt.join(first, [*group, "_cell"])
        .withColumn(
            rank,
            F.expr(f"_first + row_number() over (partition by {keys}, _cell order by {names}) - 1"),
        )
        .drop("_cell", "_first")
    )
