"""The operators of this subpackage over the given tables, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import alignment, licenses, mixing, nearest, packing, periodic, quality, rules, sharding, signature_trees, simhash, suffixes, token_counts
from .common import table

SEQUENCE = 1024
END_ID = 2
LIMIT = 2048


def op1_poisson_mixing(spark, sf):
    """Copies of the documents after mixing, sources weighted by the square root of their size."""
    docs = table(spark, sf, "documents")
    copies = mixing.mixed(docs, mixing.rates(docs))
    return copies.select("row.doc_id", "row.source", "count", "copy", "order_key", mixing.document_size("row.text").alias("size"))


def op2_suffix_index_dedup(spark, sf):
    cleaned = suffixes.cleaned(table(spark, sf, "documents").select("doc_id", "text"))
    return cleaned.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_subword_quality(spark, sf):
    docs = table(spark, sf, "documents")
    scores = quality.scored(docs, quality.trained(docs, table(spark, sf, "labels")))
    held_out = quality.fold(F.col("row.doc_id")) == 0
    return scores.select("row.doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_flow_resharding(spark, sf):
    """24 shards of equal bytes, from 16 old ones that hold whole sources."""
    docs = table(spark, sf, "documents")
    old = F.pmod(F.xxhash64("source"), F.lit(16))
    moved = sharding.resharded(docs, old, 16, 24)
    return moved.select(
        "row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


def op5_pigeonring_simhash(spark, sf):
    found = simhash.clustered(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_rule_ledger(spark, sf):
    return rules.judged(rules.ledger(table(spark, sf, "documents")))


def op7_two_tier_tokens(spark, sf):
    counts = token_counts.counted(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


def op8_license_bigrams(spark, sf):
    return licenses.scanned(table(spark, sf, "documents"))


def op9_adaptive_scan(spark, sf):
    return nearest.searched(table(spark, sf, "embeddings"), "id % 50 = 0")


def byte_pieces(docs: DataFrame) -> DataFrame:
    return packing.pieces(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, END_ID, SEQUENCE
    )


def op10_pattern_packing(spark, sf):
    pieces = written(byte_pieces(table(spark, sf, "documents")), "pieces")
    return packing.packed_pieces(pieces, SEQUENCE)


def op11_signature_trees(spark, sf):
    return signature_trees.joined(table(spark, sf, "documents"))


def op12_pair_alignment(spark, sf):
    files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    return alignment.aligned(table(spark, sf, "documents"), *files)


def op13_grammar_runs(spark, sf):
    return periodic.detected(table(spark, sf, "documents"), change=periodic.looped)


def pipeline(spark, sf):
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf)


QUERIES: list[Callable] = [op1_poisson_mixing, op2_suffix_index_dedup, op3_subword_quality, op4_flow_resharding, op5_pigeonring_simhash, op6_rule_ledger, op7_two_tier_tokens, op8_license_bigrams, op9_adaptive_scan, op10_pattern_packing, op11_signature_trees, op12_pair_alignment, op13_grammar_runs, pipeline]
