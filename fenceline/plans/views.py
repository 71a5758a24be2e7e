"""Tables derived from the given ones that stand in for the inputs of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import all_matches
from ..session import lookup_join as lookup
from ..session import held, spread, text_rows, written

LEXICON8 = ("clown", "disgusting", "idiot", "moron", "pathetic", "stupid", "trash", "worthless")
END_PIECE = "</s>"
PIECE_CHARS, PROMPT_PIECES, CHUNK_CHARS = 7, 3, 64
LOST_CHUNK = 3

_PHONE = r"\+1 \(([0-9]{3})\) ([0-9]{3})-([0-9]{4})"
_CARD = r"(^|[^0-9])([0-9]{4})([0-9]{4})([0-9]{4})([0-9]{4})([^0-9]|$)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns), "doc_id", "text")


def docs_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with phones and cards in hyphenated form, half of the phones cut to the shorter
    identifier."""
    text, even = F.col("text"), F.col("doc_id") % 2 == 0
    rewritten = F.regexp_replace(
        F.when(even, F.regexp_replace(text, _PHONE, "$1-$2-$3")).otherwise(
            F.regexp_replace(text, _PHONE, "$1-55-$3")
        ),
        _CARD,
        "$1$2-$3-$4-$5$6",
    )
    # Most texts hold neither form; two cheap tests save the rewriting.
    touched = F.contains(text, F.lit("+1 (")) | text.rlike("[0-9]{16}")
    docs = documents(spark, sf_dir).select("doc_id", F.when(touched, rewritten).otherwise(text).alias("text"))
    return held(docs, "text")


def lexicon8(spark: SparkSession) -> DataFrame:
    return text_rows(spark, LEXICON8, "term")


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon that grows with the data: the distinct space-separated words of benchmark."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ", -1)).alias("term"))
    return words.filter("term <> ''").distinct()


def pii_terms(docs: DataFrame) -> DataFrame:
    found = docs.select(F.explode(all_matches(F.col("text"))).alias("term"))
    return found.distinct()


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("row_id"),
        F.struct(F.substring(text, 1, 100).alias("text")).alias("prompt"),
        F.struct(F.substring(text, 101, 1 << 30).alias("text")).alias("continuation"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.explode(F.split("text", "\n", -1)).alias("value"))


def tokens(docs: DataFrame) -> DataFrame:
    """Texts in consecutive pieces of seven characters, the first three being the prompt."""
    pieces = F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{PIECE_CHARS}}})"), F.lit(1))
    last = F.ceil(F.length("text") / PIECE_CHARS) - 1
    return docs.select(
        F.col("doc_id").alias("seq_id"), last.alias("_last"), F.posexplode(pieces).alias("pos", "piece")
    ).select(
        "seq_id",
        F.col("pos").cast("bigint").alias("pos"),
        "piece",
        (F.col("pos") < PROMPT_PIECES).alias("is_prompt"),
        (F.col("pos") == F.col("_last")).alias("is_eos"),
    )


def chunks(docs: DataFrame) -> DataFrame:
    pieces = F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{CHUNK_CHARS}}})"), F.lit(1))
    # Cut and counted below the explode: beside it, the whole text would be cut again for each of its chunks.
    cut = held(docs.select(F.col("doc_id").alias("seq_id"), pieces.alias("_pieces")), "_pieces")
    counted = held(cut.withColumn("_n", F.size("_pieces")), "_n")
    chunked = counted.select("seq_id", "_n", F.posexplode("_pieces").alias("chunk_no", "piece"))
    return chunked.withColumn("is_last", F.col("chunk_no") == F.col("_n") - 1).drop("_n")


def timed_chunks(docs: DataFrame) -> DataFrame:
    """Chunks with the time they were sent: one a second, from a fixed day on."""
    return chunks(docs).withColumn("sent", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("chunk_no")))


def lossy_chunks(docs: DataFrame) -> DataFrame:
    """Timed chunks, of which every seventh sequence has lost the fourth, unless it is the last."""
    lost = (F.col("seq_id") % 7 == 0) & (F.col("chunk_no") == LOST_CHUNK) & ~F.col("is_last")
    return timed_chunks(docs).filter(~lost)


def heartbeat(spark: SparkSession) -> DataFrame:
    """A chunk of no sequence, sent long after the others: the watermark passes all of them."""
    row = spark.range(1).select(F.lit(-1).cast("bigint").alias("seq_id"), F.lit(0).alias("chunk_no"), F.lit("").alias("piece"), F.lit(True).alias("is_last"))
    return row.withColumn("sent", F.timestamp_seconds(F.lit(1_710_000_000)))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct non-empty words of documents, written once: every reader would scan the corpus again."""
    words = F.array_distinct(F.split("text", " ", -1))
    pieces = documents(spark, sf_dir).select(F.explode(words).alias("piece")).filter("piece <> ''").distinct()
    return written(pieces, "vocabulary")


def word_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constraint for each lower-case word of at least ten letters: the word, behind it the beginning of a word with "ed" or "ing"."""
    word = F.col("piece")
    kept = vocabulary(spark, sf_dir).filter(word.rlike("^[a-z]{10,}$"))
    return kept.select(
        word.alias("constraint_id"), F.lit(0).alias("ord"), F.lit("regex").alias("kind"), F.concat(word, F.lit("[,.]? [a-z]*(?:ed|ing)")).alias("pattern"), F.lit(-1.0).alias("penalty")
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.split("text", " ", -1).alias("w"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-word candidates: a word of the corpus is a sequence of one step, its successors are the
    candidates, the log of their count is the score; an end marker, known by ``is_eos``, is added to
    every step."""
    counted = successors(spark, sf_dir)
    # With their count the pairs of the ends are the shuffle of the scores: texts are cut into pairs once.
    return _scored(counted).unionByName(_ends(counted.filter("n > 0")))


def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, cand, n): how often a word of the corpus follows another."""
    w, n = F.col("w"), F.size("w")
    pairs = F.arrays_zip(F.slice(w, F.lit(1), n - 1).alias("c"), F.slice(w, F.lit(2), n - 1).alias("s"))
    return (
        words(spark, sf_dir)
        .filter("size(w) > 1")
        .select(F.explode(pairs).alias("p"))
        .groupBy(F.col("p.c").alias("seq_id"), F.col("p.s").alias("cand"))
        .agg(F.count("*").alias("n"))
    )


def _scored(counted: DataFrame) -> DataFrame:
    return counted.select("seq_id", F.lit(0).alias("step"), "cand", F.ln("n").alias("logit"), F.lit(False).alias("is_eos"))


def _ends(counted: DataFrame) -> DataFrame:
    return counted.select("seq_id").distinct().select(
        "seq_id", F.lit(0).alias("step"), F.lit(END_PIECE).alias("cand"), F.lit(0.0).alias("logit"), F.lit(True).alias("is_eos")
    )


def candidate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates as tables, for queries that read them more than once. The ends come from what is written, so that pairs are counted once."""
    counted = written(successors(spark, sf_dir), "candidates")
    return _scored(counted).unionByName(written(_ends(counted), "ends"))


def nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "n_chars").select(
        (F.col("doc_id") % 100).alias("prompt_id"),
        F.col("doc_id").alias("gen_id"),
        F.col("text").alias("output"),
        (-F.col("n_chars") / F.lit(10.0)).alias("sum_logprob"),
        F.size(F.split("text", " ", -1)).alias("n_tokens"),
    )


def _file_name() -> Column:
    d = F.col("doc_id")
    return F.when(d % 11 == 0, F.lit("broken_name.jsonl")).otherwise(
        F.concat(
            F.concat_ws(
                "_",
                F.element_at(F.array(F.lit("base"), F.lit("ours")), (d % 2 + 1).cast("int")),
                F.element_at(F.array(F.lit("RTP"), F.lit("Enron"), F.lit("Other")), (d % 3 + 1).cast("int")),
                F.element_at(
                    F.array(F.lit("Llama_3.1_8B"), F.lit("gpt_j_6b"), F.lit("phi_4")), (d % 5 % 3 + 1).cast("int")
                ),
                F.when(d % 7 < 4, F.lit("1")).otherwise(F.lit("8")),
                F.lit("42"),
            ),
            F.lit(".jsonl"),
        )
    )


def generations(docs: DataFrame) -> DataFrame:
    """Model outputs: the text with its prompt behind an end marker, without it, or in front."""
    text = F.col("text")
    output = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("</s> "), text))
        .when(F.col("doc_id") % 4 == 1, F.substring(text, 31, 1 << 30))
        .otherwise(text)
    )
    return docs.select(
        _file_name().alias("file"),
        F.col("doc_id").alias("idx"),
        F.substring(text, 1, 30).alias("prompt"),
        output.alias("output"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the generations and one file without rows."""
    named = table(spark, sf_dir, "documents").select(_file_name().alias("file")).distinct()
    return named.unionByName(text_rows(spark, ["ours_Enron_phi_4_16_42.jsonl"], "file"))


def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result file names, good and broken, made from document attributes."""
    d = F.col("doc_id")

    def pick(values, by):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))

    models = ("Llama_3.1_8B", "Llama-3.1-8B_Instruct", "gpt_j_6b", "PHI_4", "Qwen2.5_7B", "unknown", "Falcon3_7B")
    name = F.concat_ws(
        "_",
        pick(("ours", "base"), d),
        F.concat(pick(("RTP", "Enron", "mail"), d), F.lit("_"), F.col("source")),
        pick(models, d),
        pick(("1", "8", "x8", "16"), F.floor(d / 7)),
        F.concat(d.cast("string"), pick(("", "", "", "s"), F.floor(d / 3))),
    )
    short = F.concat(F.lit("a_"), d.cast("string"))
    bare = F.concat(F.lit("ours_gpt_j_6b_1_"), d.cast("string"))
    chosen = F.when(d % 13 == 0, short).when(d % 17 == 0, bare).otherwise(name)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("result/"), F.col("lang"), F.lit("/"), chosen, F.lit(".jsonl")).alias("file")
    )


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON records of seven shapes."""
    t, head, kind = F.col("text"), F.substring("text", 1, 30), F.col("doc_id") % 7
    none = F.lit(None).cast("string")

    def record(**values) -> Column:
        return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})

    value = (
        F.when(kind == 0, record(prompt=head, output=t))
        .when(kind == 1, record(prompt=F.struct(head.alias("text")), output=F.struct(t.alias("text"))))
        .when(kind == 2, record(input=head, completion=t, output=F.lit("")))
        .when(kind == 3, record(instruction=head, output=F.lit(7), answer=t))
        .when(kind == 4, record(query=head, output=none, continuation=F.struct(t.alias("text"))))
        .when(kind == 5, record(prompt=F.array(head), output=F.struct(F.lit(5).alias("text"))))
        .otherwise(record(id=F.col("doc_id")))
    )
    return documents(spark, sf_dir).select("doc_id", value.alias("value"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("event_type").alias("run_id"),
            F.col("event_id").alias("batch_no"),
            F.floor(F.col("value") * 10).cast("bigint").alias("new_tokens"),
            (F.col("value") / 10).alias("seconds"),
        )
    )
