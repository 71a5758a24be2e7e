"""From a folder of result files to a violation report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import runs
from ..operators import terms as T
from ..sources import readers


def evaluate(
    spark: SparkSession,
    root: str,
    lexicon_path: str,
    pattern: str = "*.jsonl",
    prompt_key: str = "prompt",
    answer_key: str = "output",
) -> tuple[DataFrame, DataFrame]:
    """(report, rejects) of the result files directly below ``root``. Badly named files are rejected
    by their names and never read."""
    files = readers.list_files(spark, root, pattern)
    named = [r["file"] for r in runs.parse_names(files).filter("error IS NULL").select("file").collect()]
    generations = readers.read_generations(spark, root, pattern, prompt_key, answer_key, named)
    lex = T.lexicon(readers.read_evaluation_lexicon(spark, lexicon_path), T.EVAL)
    return runs.violation_report(files, generations, lex), runs.rejects(files)
