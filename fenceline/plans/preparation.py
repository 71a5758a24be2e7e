"""From a corpus to constraint lexicons, affected documents and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import text_or_empty
from ..operators import sampling, spans
from ..operators import terms as T
from ..session import written


def pii_prompts(docs: DataFrame) -> DataFrame:
    """(doc_id, prompt): eligible documents cut before their leftmost match."""
    return spans.eligible(docs).select("doc_id", P.prompt_cut(F.col("text")).alias("prompt"))


def pii_sample(docs: DataFrame, n: int = sampling.SAMPLE_SIZE, seed: int = sampling.SEED) -> DataFrame:
    return sampling.seeded_sample(spans.eligible(docs), "doc_id", n, seed)


def span_lexicon(docs: DataFrame, n: int = sampling.SAMPLE_SIZE, seed: int = sampling.SEED) -> DataFrame:
    """(span): distinct sorted matches of a seeded sample of eligible documents."""
    return spans.distinct_spans(pii_sample(docs, n, seed))


def counted_span_lexicon(docs: DataFrame, n: int = sampling.SAMPLE_SIZE, seed: int = sampling.SEED) -> tuple[DataFrame, DataFrame]:
    """The table (span) of :func:`span_lexicon`, and (stage, n): how many documents were eligible, how many were sampled and how
    many spans there are. The corpus is read once: what is eligible is counted in the job that draws the sample."""
    spark = docs.sparkSession
    eligible = Observation("eligible")
    seen = spans.eligible(docs).observe(eligible, F.count(F.lit(1)).alias("n"))
    sample = written(sampling.seeded_sample(seen, "doc_id", n, seed), "sample")
    table = written(spans.distinct_spans(sample), "spans")
    # The sample and the spans are tables by now. An empty sample says that nothing was eligible.
    sampled = sample.count()
    counts = [("eligible", eligible.get["n"] if sampled else 0), ("sampled", sampled), ("spans", table.count())]
    return table, spark.createDataFrame(counts, "stage STRING, n BIGINT")


def toxic_prompts(prompts: DataFrame, lex: T.Lexicon) -> DataFrame:
    """(row_id, prompt): rows with a usable prompt whose continuation holds a term. The length test
    comes first: it is cheap and needs no text scan."""
    flat = prompts.select(
        "row_id",
        text_or_empty(F.col("prompt")).alias("prompt"),
        text_or_empty(F.col("continuation")).alias("text"),
    )
    usable = flat.filter(P.usable_prompt(F.col("prompt")))
    return T.containing(usable, lex).select("row_id", "prompt")
