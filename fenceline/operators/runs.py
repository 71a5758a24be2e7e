"""Result files: names, modes, violation reports and run summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import norm, strip_prompt
from . import terms as T

# Known model aliases.
MODEL_ALIASES = (
    "gpt_j_6b",
    "gpt_neo_2.7B",
    "Llama_2_7b_hf",
    "Llama_3.1_8B",
    "Qwen2.5_7B",
    "Llama_3.1_8B_Instruct",
    "Falcon3_7B",
    "falcon_7b_instruct",
    "phi_4",
    "pythia_6.9b",
)
# The two evaluation modes and their marks in a path.
REGEX_MODE, TERM_MODE, NO_MODE = "enron_regex", "rtp_toxic_vocab", "unsupported"
REGEX_MARK, TERM_MARK = "enron", "rtp"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def stem(name: Column) -> Column:
    """The name without its last extension (a leading dot starts no extension)."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "")


def parse_names(files: DataFrame, path: str = "file", aliases=MODEL_ALIASES) -> DataFrame:
    """Add method, dataset, model_alias, batch_size, seed and error of a result file name.

    The model is the longest run of parts before the batch size that is a known alias; what is left
    before it is the dataset. ``error`` is NULL for a good name.
    """
    name, error = F.col("_name"), F.col("error")
    parts, core, model = F.col("_parts"), F.col("_core"), F.col("_model")
    # The leftmost alias that reaches the end is the longest one.
    known = "|".join(sorted({re.sub("[-._]", "[-._]", a.strip()) for a in aliases}))
    alias = rf"(?i)(?:\A|_)(\s*(?:{known})\s*)\z"
    parsed = (
        files.withColumn("_name", base_name(F.col(path)))
        .withColumn("_parts", F.split(stem(name), "_", -1))
        .withColumn("_core", F.concat_ws("_", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 3, F.lit(0)))))
        .withColumn("_model", F.regexp_extract(core, alias, 1))
        # The messages.
        .withColumn(
            "error",
            F.when(F.size(parts) < 5, F.concat(F.lit("Too few parts: "), name))
            .when(~F.element_at(parts, -1).rlike(r"\A[0-9]+\z"), F.concat(F.lit("Seed not numeric: "), name))
            .when(~F.element_at(parts, -2).rlike(r"\A[0-9]+\z"), F.concat(F.lit("Batch size not numeric: "), name))
            .when(model == "", F.concat(F.lit("Cannot parse model alias: "), name))
            .when(model == core, F.concat(F.lit("Cannot parse dataset: "), name)),
        )
    )
    values = {
        "method": F.element_at(parts, 1),
        "dataset": F.left(core, F.length(core) - F.length(model) - 1),
        "model_alias": model,
        "batch_size": F.get(parts, F.size(parts) - 2),
        "seed": F.element_at(parts, -1),
    }
    return parsed.select(*files.columns, *[F.when(error.isNull(), v).alias(n) for n, v in values.items()], "error")


def mode(path: Column) -> Column:
    """Evaluation mode from the whole normalised path."""
    p = norm(path)
    return (
        F.when(F.contains(p, F.lit(REGEX_MARK)), F.lit(REGEX_MODE))
        .when(F.contains(p, F.lit(TERM_MARK)), F.lit(TERM_MODE))
        .otherwise(F.lit(NO_MODE))
    )


def output_name(dataset: Column, model: Column, batch_size: Column, seed: Column) -> Column:
    """Name of a result file of this method for a model given as ``owner/name``."""
    short = F.replace(F.split_part(F.split_part(model, F.lit("/"), F.lit(2)), F.lit("-Instruct"), F.lit(1)), F.lit("-"), F.lit("_"))
    return F.concat(
        # Fixed value: the prefix of this method.
        F.concat_ws("_", F.lit("ours"), dataset, short, batch_size.cast("string"), seed.cast("string")),
        F.lit(".jsonl"),
    )


def judged(generations: DataFrame, lexicon: T.Lexicon, patterns=P.PII) -> DataFrame:
    """Add ``hit``: whether the answer behind its prompt violates under the mode of its file. It depends
    on the answer and the mode only; ``idx`` may be NULL or repeated."""
    rows = generations.withColumn("_mode", mode(F.col("file"))).withColumn(
        "_answer", strip_prompt(F.col("prompt"), F.col("output"))
    )
    # Terms are looked up in the answers of their mode alone.
    asked = rows.withColumn("_asked", F.when(F.col("_mode") == TERM_MODE, F.col("_answer")))
    flagged = T.flagged(asked, lexicon, "_term_hit", "_asked")
    regex_hit = F.coalesce(P.has_match(F.col("_answer"), patterns), F.lit(False))
    hit = (
        F.when(F.col("_mode") == REGEX_MODE, regex_hit)
        .when(F.col("_mode") == TERM_MODE, F.col("_term_hit"))
        .otherwise(False)
    )
    return flagged.withColumn("hit", hit).select(*generations.columns, "hit")


def violation_report(files: DataFrame, generations: DataFrame, lexicon: T.Lexicon, patterns=P.PII) -> DataFrame:
    """One row per well-named file, files without rows included.

    The rate is a percentage, NaN without rows or with an unsupported mode.
    """
    counts = (
        judged(generations, lexicon, patterns)
        .groupBy("file")
        .agg(F.count("*").alias("total_examples"), F.count_if("hit").alias("violations"))
    )
    total, bad = F.coalesce("total_examples", F.lit(0)), F.coalesce("violations", F.lit(0))
    rated = (total > 0) & (F.col("mode") != NO_MODE)
    return (
        parse_names(files)
        .filter("error IS NULL")
        .withColumn("mode", mode(F.col("file")))
        .join(counts, "file", "left")
        .select(
            "file",
            "method",
            "dataset",
            "model_alias",
            "batch_size",
            "seed",
            "mode",
            total.alias("total_examples"),
            bad.alias("violations"),
            F.when(rated, bad / total * 100).otherwise(F.lit(float("nan"))).alias("violation_rate"),
        )
    )


def rejects(files: DataFrame) -> DataFrame:
    """(file, error) of badly named files; the file is reported by its name."""
    bad = parse_names(files).filter("error IS NOT NULL")
    return bad.select(base_name(F.col("file")).alias("file"), "error")


def run_summary(report: DataFrame, base_method: str = "base") -> DataFrame:
    """Pooled violation rate per method, dataset, model and batch size, next to the rate of the
    unconstrained method on the same dataset, model and batch size."""
    setting = ["dataset", "model_alias", "batch_size"]
    rate = F.when(F.col("total_examples") > 0, F.col("violations") / F.col("total_examples") * 100)
    pooled = (
        report.filter(F.col("mode") != NO_MODE)
        .groupBy("method", *setting)
        .agg(
            F.count("*").alias("n_files"),
            F.sum("total_examples").alias("total_examples"),
            F.sum("violations").alias("violations"),
        )
        .withColumn("violation_rate", rate)
    )
    base = F.max(F.when(F.col("method") == base_method, F.col("violation_rate")))
    return pooled.withColumn("base_rate", base.over(Window.partitionBy(*setting)))


def run_rollup(report: DataFrame) -> DataFrame:
    """Pooled violation rates by dataset, model and method, with subtotals: ``level`` says how many of the three are summed over (0 to 3), which
    then are NULL."""
    rate = F.when(F.col("total_examples") > 0, F.col("violations") / F.col("total_examples") * 100)
    return (
        report.filter(F.col("mode") != NO_MODE)
        .rollup("dataset", "model_alias", "method")
        .agg(
            F.grouping_id().alias("_g"),
            F.count("*").alias("n_files"),
            F.sum("total_examples").alias("total_examples"),
            F.sum("violations").alias("violations"),
        )
        .withColumn("level", F.bit_count("_g"))
        .withColumn("violation_rate", rate)
        .drop("_g")
    )


def setting_throughput(files: DataFrame, run_log: DataFrame, base_method: str = "base") -> DataFrame:
    """Tokens per second per method, dataset, model and batch size, and relative to the unconstrained
    method in the same setting. ``run_log`` has (file, new_tokens, seconds); badly named files are left out."""
    setting = ["dataset", "model_alias", "batch_size"]
    totals = run_log.groupBy("file").agg(F.sum("new_tokens").alias("new_tokens"), F.sum("seconds").alias("seconds"))
    pooled = (
        parse_names(files)
        .filter("error IS NULL")
        .join(totals, "file")
        .groupBy("method", *setting)
        .agg(F.sum("new_tokens").alias("new_tokens"), F.sum("seconds").alias("seconds"))
        .withColumn("tokens_per_second", F.when(F.col("seconds") > 0, F.col("new_tokens") / F.col("seconds")))
    )
    # A setting has a row per method.
    base = F.max(F.when(F.col("method") == base_method, F.col("tokens_per_second")))
    return pooled.withColumn("relative", F.col("tokens_per_second") / base.over(Window.partitionBy(*setting)))


def throughput(run_log: DataFrame) -> DataFrame:
    """Tokens per second of a run: the ratio of the sums."""
    seconds = F.col("seconds")
    return (
        run_log.groupBy("run_id")
        .agg(F.sum("new_tokens").alias("new_tokens"), F.sum("seconds").alias("seconds"))
        .withColumn("tokens_per_second", F.when(seconds > 0, F.col("new_tokens") / seconds))
    )


def relative_throughput(run_log: DataFrame, base_run: str) -> DataFrame:
    """Throughput of every run divided by that of the unconstrained run."""
    rates = throughput(run_log)
    base = throughput(run_log.filter(F.col("run_id") == base_run)).first()
    rate = F.lit(None if base is None else base["tokens_per_second"]).cast("double")
    return rates.withColumn("relative", F.col("tokens_per_second") / rate)
