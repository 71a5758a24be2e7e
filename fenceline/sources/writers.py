"""Sinks: lexicons, generation records, reports and partitioned results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import running
from ..schemas import REPORT_COLUMNS, RUN
from ..session import fits_broadcast


def write_json_lexicon(terms: DataFrame, path: str, order: str = "term") -> None:
    """The terms as one JSON array in the order of a column, indented, characters unescaped.

    One array is one value, so its size is checked; ``write_json_lines_lexicon`` has no such bound.
    """
    if not fits_broadcast(terms.select("term")):
        raise ValueError("too large for one value; use write_json_lines_lexicon")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("term").alias("t"))))["t"]
    quoted = F.transform(ordered, lambda t: F.regexp_replace(F.to_json(F.array(t)), r"\A\[|\]\z", ""))
    body = F.concat(F.lit("[\n  "), F.array_join(quoted, ",\n  "), F.lit("\n]"))
    value = F.when(F.size(ordered) > 0, body).otherwise(F.lit("[]"))
    terms.agg(value.alias("value")).write.mode("overwrite").text(path)


def write_json_lines_lexicon(terms: DataFrame, path: str, order: str = "term") -> None:
    """The same array as :func:`write_json_lexicon`, one term a line, for any number of terms: parts in the order of a column, whose lines
    one after the other are the array. No part is larger than a range of the order."""
    one = F.regexp_replace(F.to_json(F.array("term")), r"\A\[|\]\z", "")
    # Several terms of one place are in any order.
    numbered = running.numbered(terms.select(F.col(order).alias("_o"), "term"), ["_o"])
    total = numbered.count()
    comma = F.when(F.col("idx") < total - 1, ",").otherwise("")
    lines = numbered.select("idx", F.concat(F.lit("  "), one, comma).alias("value"))
    ends = terms.sparkSession.createDataFrame([(-1, "["), (total, "]")], "idx BIGINT, value STRING")
    lines.unionByName(ends).repartitionByRange("idx").sortWithinPartitions("idx").select("value").write.mode("overwrite").text(path)


def write_spans(spans: DataFrame, path: str) -> None:
    spans.write.mode("overwrite").parquet(path)


def write_generations(generations: DataFrame, path: str) -> None:
    """Records {idx, prompt, output} as JSON lines."""
    generations.select("idx", "prompt", "output").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_report(report: DataFrame, root: str, out: str = "violation_results.csv") -> str:
    """The report as CSV with a header; the path is ``root`` + "_" + ``out``."""
    path = f"{root}_{out}"
    report.select(*REPORT_COLUMNS).orderBy("file").write.mode("overwrite").option("header", True).csv(path)
    return path


def write_results(results: DataFrame, path: str) -> None:
    """Results laid out by run, so that a filter on the run prunes files; what was there goes."""
    results.write.mode("overwrite").partitionBy(*RUN).parquet(path)


def rewrite_runs(results: DataFrame, path: str) -> None:
    """The runs that occur in ``results`` are replaced; all others stay as they are."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN).parquet(path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    rejects.select("file", "error").write.mode("overwrite").option("header", True).csv(path)
