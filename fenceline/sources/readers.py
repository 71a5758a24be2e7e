"""Sources: lexicons, corpora, generation files and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.fields import answer_text, prompt_text
from ..functions.text import strip


def source_path() -> Column:
    """Path of the file a row was read from, as the file listing names it."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def corpus(spark: SparkSession, path: str, schema: str | None = None, format: str = "parquet") -> DataFrame:
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema else reader).load(path)


def lexicon_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Terms of a line list: stripped, without blank lines and ``#`` comments, duplicates kept."""
    term = strip(F.col(value))
    return lines.select(term.alias("term")).filter((F.col("term") != "") & ~F.startswith("term", F.lit("#")))


def read_lexicon_lines(spark: SparkSession, path: str) -> DataFrame:
    return lexicon_lines(spark.read.text(path))


def _listed(spark: SparkSession, path: str, pattern: str | None = None) -> list[tuple[str, int]]:
    """(path, length) of a path, or of the files of a folder that match a glob, seen through the
    file system Spark reads from. Spark's own sources leave empty files out."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = hadoop_path(path) if pattern is None else hadoop_path(path, pattern)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    files = [f for f in found or [] if pattern is None or f.isFile()]
    return [(f.getPath().toString(), f.getLen()) for f in files]


def read_json_lexicons(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Terms of several JSON-array files (set union) and the rejected files.

    ``rejects`` (file, error) names missing files and payloads that are no array.
    """
    present = [p for p in paths if _listed(spark, p)]
    missing = [(p, "File not found") for p in paths if p not in present]
    rejects = spark.createDataFrame(missing, "file STRING, error STRING")
    if not present:
        return spark.createDataFrame([], schemas.LEXICON), rejects
    payload = (
        spark.read.text(present, wholetext=True)
        .select(source_path().alias("file"), F.parse_json("value").alias("v"))
        .withColumn("items", F.try_variant_get("v", "$", "array<variant>"))
    )
    terms = (
        payload.filter("items IS NOT NULL")
        .select(F.explode("items").alias("item"))
        .filter(F.schema_of_variant("item") == "STRING")
        .select(F.try_variant_get("item", "$", "string").alias("term"))
        .distinct()
    )
    bad = payload.filter("items IS NULL").select("file", F.lit("Not an array").alias("error"))
    return terms, rejects.unionByName(bad)


def read_json_lines_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a JSON array with one item a line, of any size: strings only, duplicates kept, in no order. The lines are read apart."""
    item = F.regexp_replace(strip(F.col("value")), r",\z", "")
    items = spark.read.text(path).select(item.alias("value")).filter(~F.col("value").isin("[", "]", "")).select(F.parse_json("value").alias("item"))
    return items.filter(F.schema_of_variant("item") == "STRING").select(F.try_variant_get("item", "$", "string").alias("term"))


def read_results(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Results laid out by run: ``columns`` (DDL) and those of the run, all of them strings. A filter on the run reads its files only."""
    return spark.read.schema(f"{columns}, {', '.join(f'{c} STRING' for c in schemas.RUN)}").parquet(path)


def read_evaluation_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Terms of one JSON-array file: strings only, stripped, lowered, blanks dropped, duplicates
    kept. A payload that is no array gives no terms."""
    items = (
        spark.read.text(path, wholetext=True)
        .select(F.try_variant_get(F.parse_json("value"), "$", "array<variant>").alias("items"))
        .select(F.explode("items").alias("item"))
    )
    return (
        items.filter(F.schema_of_variant("item") == "STRING")
        .select(F.lower(strip(F.try_variant_get("item", "$", "string"))).alias("term"))
        .filter("term <> ''")
    )


def list_files(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """(file, length) of every matching file directly below ``root``, sorted; empty files too.
    Contents are not read. Raises when nothing matches."""
    found = sorted(_listed(spark, root, pattern))
    if not found:
        raise FileNotFoundError(f"No files matched: {root}/{pattern}")
    return spark.createDataFrame(found, "file STRING, length BIGINT")


def read_records(
    spark: SparkSession, root: str, pattern: str = "*.jsonl", files: list[str] | None = None
) -> DataFrame:
    """(file, record VARIANT) of every non-blank line of the matching files below ``root``, or of ``files``
    alone; a malformed line fails the query."""
    if files is None:
        lines = spark.read.option("pathGlobFilter", pattern).text(root)
    elif files:
        lines = spark.read.text(files)
    else:
        return spark.createDataFrame([], "file STRING, value STRING").select("file", F.parse_json("value").alias("record"))
    return lines.select(source_path().alias("file"), strip(F.col("value")).alias("value")).filter(
        "value <> ''"
    ).select("file", F.parse_json("value").alias("record"))


def generations(records: DataFrame, prompt_key: str = "prompt", answer_key: str = "output") -> DataFrame:
    """(file, idx, prompt, output) from schema-less records."""
    record = F.col("record")
    return records.select(
        "file",
        F.try_variant_get(record, "$.idx", "bigint").alias("idx"),
        prompt_text(record, prompt_key).alias("prompt"),
        answer_text(record, answer_key).alias("output"),
    )


def read_generations(
    spark: SparkSession,
    root: str,
    pattern: str = "*.jsonl",
    prompt_key: str = "prompt",
    answer_key: str = "output",
    files: list[str] | None = None,
) -> DataFrame:
    return generations(read_records(spark, root, pattern, files), prompt_key, answer_key)


def stream(
    spark: SparkSession,
    path: str,
    schema: str,
    format: str = "parquet",
    files_per_trigger: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """A stream of files, such as chunks (seq_id, chunk_no, piece)."""
    reader = spark.readStream.format(format).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)
