"""Streaming filters and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import spans
from ..operators import terms as T
from ..session import lookup_join, shared_folder, written
from . import ordered


def violating(stream: DataFrame, text: str = "text") -> DataFrame:
    """Rows of a stream with a forbidden match; the batch filter holds for streams as it is."""
    return spans.violating(stream, text)


def write_term_alerts(
    stream: DataFrame, lexicon: T.Lexicon, path: str, checkpoint: str, text: str = "text"
) -> StreamingQuery:
    """Rows of a stream whose text holds a term of a lexicon of any size, under its preset, below ``path``.

    Each micro-batch is filtered as a table; its rows lie in a folder of its number, which a repeated
    batch writes again."""

    def keep(batch: DataFrame, number: int) -> None:
        T.containing(batch, lexicon, text).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_term_completions(chunks: DataFrame, lexicon: T.Lexicon, path: str, checkpoint: str, **order) -> StreamingQuery:
    """(seq_id, end, chunk_no) of the first forbidden term that a stream of chunks completes, once per sequence, below ``path``; for a raw lexicon of any
    size.

    The state carries the characters in which a term may have begun; each micro-batch is then a table of texts that is joined with the
    lexicon by anchored grams. ``order`` goes to :func:`ordered.carried`. A repeated batch is written again.
    """
    spark = chunks.sparkSession
    longest = lexicon.terms.agg(F.max(F.length("term"))).first()[0] or 1

    def find(batch: DataFrame, number: int) -> None:
        # Written first: the stateful part must run once.
        texts = written(batch.withColumnRenamed("start", "base"), "carried")
        end = F.col("start") + F.length("term")
        # What ends inside the carried text ended in an earlier chunk.
        new = T.occurrences(texts, lexicon, ["seq_id", "chunk_no", "base", "halo"]).filter(end > F.col("halo"))
        first = F.min(F.struct((F.col("base") + end).alias("end"), "chunk_no"))
        found = new.groupBy("seq_id").agg(first.alias("_f")).select("seq_id", "_f.*")
        # A sequence that a batch before has reported gives nothing more.
        if earlier := [f"{path}/batch={n}" for n in range(number)]:
            known = spark.read.schema("seq_id BIGINT").parquet(*earlier)
            found = lookup_join(found, known, "seq_id", "left_anti")
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    carried = ordered.carried(chunks, longest - 1, **order)
    return carried.writeStream.foreachBatch(find).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_alerts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to parquet, processing what is available and then stopping. The checkpoint
    folder makes a restarted query go on where it ended."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over all available input; its output as a table in the shared folder."""
    spark = stream.sparkSession
    out = shared_folder(spark, "alerts")
    write_alerts(stream, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")
