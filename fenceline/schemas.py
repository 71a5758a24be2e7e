"""Table schemas (DDL) shared by sources, operators and sinks."""

CORPUS = "doc_id BIGINT, text STRING"
PROMPTS = "row_id BIGINT, prompt STRUCT<text: STRING>, continuation STRUCT<text: STRING>"
LEXICON = "term STRING"
GENERATIONS = "file STRING, idx BIGINT, prompt STRING, output STRING"
TOKENS = "seq_id BIGINT, pos BIGINT, piece STRING, is_prompt BOOLEAN, is_eos BOOLEAN"
CHUNKS = "seq_id BIGINT, chunk_no INT, piece STRING"
RUN_LOG = "run_id STRING, batch_no BIGINT, new_tokens BIGINT, seconds DOUBLE"

# Columns of the report, in order.
REPORT_COLUMNS = [
    "file",
    "method",
    "dataset",
    "model_alias",
    "batch_size",
    "seed",
    "mode",
    "total_examples",
    "violations",
    "violation_rate",
]

# What names a run.
RUN = ["method", "dataset", "model_alias", "batch_size", "seed"]
