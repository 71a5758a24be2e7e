"""Named queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields, sql, text
from ..functions import patterns as P
from ..operators import candidates as C
from ..operators import constraints as K
from ..operators import lexicon as L
from ..operators import redaction, running, runs, sampling, sequences, spans
from ..operators import terms as T
from ..schemas import RUN
from ..session import lookup_join, shared_folder, written
from ..sources import readers, writers
from ..streaming import alerts, chunks, ordered
from . import preparation
from . import views as V


def _lex8(spark: SparkSession, preset: str, literal_terms: int = T.LITERAL_TERMS) -> T.Lexicon:
    return T.lexicon(V.lexicon8(spark), preset, literal_terms)


# --- documents and patterns ---------------------------------------------------------------


def pii_by_pattern(spark, sf):
    docs = spans.eligible(V.documents(spark, sf))
    body = F.col("text")
    return docs.groupBy(P.first_reason(body).alias("reason")).agg(
        F.count("*").alias("n_docs"),
        F.round(F.avg(F.length(P.prompt_cut(body))), 6).alias("avg_prompt_chars"),
    )


def pii_select(spark, sf):
    return preparation.pii_prompts(V.docs_pii(spark, sf)).withColumn("prompt_chars", F.length("prompt"))


def pii_first_reason(spark, sf):
    return V.docs_pii(spark, sf).select("doc_id", P.first_reason(F.col("text")).alias("reason"))


def pii_reason_counts(spark, sf):
    return spans.count_by_reason(V.docs_pii(spark, sf))


def pii_spans(spark, sf):
    return spans.spans(V.docs_pii(spark, sf))


def pii_spans_distinct(spark, sf):
    return spans.distinct_spans(V.docs_pii(spark, sf))


def pii_first_completion(spark, sf):
    body = F.col("text")
    ends = [P.completion_end(body, p).alias(f"end_{p.name}") for p in P.PII]
    return spans.violating(V.docs_pii(spark, sf)).select("doc_id", *ends, P.first_completion(body).alias("end_first"))


def pii_clean_prefix(spark, sf):
    return V.docs_pii(spark, sf).select("doc_id", P.clean_prefix(F.col("text")).alias("prefix"))


def pii_redact(spark, sf):
    return V.docs_pii(spark, sf).select("doc_id", P.redact(F.col("text")).alias("redacted"))


def redact_all(spark, sf):
    """Matches of patterns and terms of a lexicon of any size, overlaps replaced as one."""
    return redaction.redact_all(V.docs_pii(spark, sf), _lex8(spark, T.ENFORCE, 0)).select("doc_id", "redacted")


def pii_clean_docs(spark, sf):
    return spans.clean(V.docs_pii(spark, sf)).select("doc_id")


def span_lexicon(spark, sf):
    return preparation.span_lexicon(V.docs_pii(spark, sf))


def stage_counts(spark, sf):
    return preparation.counted_span_lexicon(V.docs_pii(spark, sf))[1]


def page_spans(spark, sf):
    pages = V.table(spark, sf, "pages").select("page_id", "html")
    return spans.spans(pages, key="page_id", text="html").select("page_id", "ord", "span")


def source_flags(spark, sf):
    hit = P.has_match(F.col("text"))
    return V.documents(spark, sf, "source").groupBy("source").agg(
        F.bool_or(hit).alias("any_violation"), F.bool_and(~hit).alias("all_clean")
    )


# --- lexicons -----------------------------------------------------------------------------


def lexicon_lines(spark, sf):
    return readers.lexicon_lines(V.lines(spark, sf))


def lexicon_union(spark, sf):
    spans_ = V.pii_terms(V.docs_pii(spark, sf))
    return V.benchmark_words(spark, sf).unionByName(V.lexicon8(spark)).unionByName(spans_).distinct()


def toxic_select(spark, sf):
    return preparation.toxic_prompts(V.prompts(spark, sf), _lex8(spark, T.SELECT))


def toxic_eval(spark, sf):
    return T.containing(V.documents(spark, sf), _lex8(spark, T.EVAL)).select("doc_id")


def toxic_raw(spark, sf):
    return T.containing(V.documents(spark, sf), _lex8(spark, T.ENFORCE)).select("doc_id")


def toxic_select_grams(spark, sf):
    return T.containing(V.documents(spark, sf), _lex8(spark, T.SELECT, 0)).select("doc_id")


def toxic_raw_grams(spark, sf):
    return T.containing(V.documents(spark, sf), _lex8(spark, T.ENFORCE, 0)).select("doc_id")


def term_counts(spark, sf):
    """All three meanings of a term in one pass."""
    lexicons = [_lex8(spark, preset) for preset in (T.ENFORCE, T.SELECT, T.EVAL)]
    return T.hits_by_preset(V.documents(spark, sf), lexicons).groupBy("preset", "term").agg(F.count("*").alias("n_docs"))


def word_doc_counts(spark, sf):
    return T.term_counts(V.documents(spark, sf), T.lexicon(V.benchmark_words(spark, sf), T.EVAL))


def word_raw_counts(spark, sf):
    return T.term_counts(V.documents(spark, sf), T.lexicon(V.benchmark_words(spark, sf), T.ENFORCE))


def span_term_docs(spark, sf):
    docs = V.docs_pii(spark, sf)
    # A table: the lexicon is read several times, the texts once for it.
    return T.hits(docs, T.lexicon(written(V.pii_terms(docs), "found"), T.ENFORCE))


def clean_docs(spark, sf):
    return T.without(spans.clean(V.docs_pii(spark, sf)), _lex8(spark, T.ENFORCE)).select("doc_id")


def lexicon_states(spark, sf):
    return L.states(V.benchmark_words(spark, sf))


def lexicon_failure(spark, sf):
    return L.failure_links(V.benchmark_words(spark, sf))


def lexicon_forbidden(spark, sf):
    return L.forbidden_states(V.benchmark_words(spark, sf))


def redundant_terms(spark, sf):
    return T.redundant_terms(V.benchmark_words(spark, sf))


def minimal_terms(spark, sf):
    return T.minimal_terms(V.benchmark_words(spark, sf))


def vocab_state_mask(spark, sf):
    return L.state_table(V.lexicon8(spark), V.vocabulary(spark, sf))


def vocab_blocked(spark, sf):
    return L.blocked_alone(V.vocabulary(spark, sf), _lex8(spark, T.ENFORCE))


def _merges(vocabulary: DataFrame) -> DataFrame:
    """Pairs of vocabulary words whose concatenation is a word as well."""
    cuts = F.sequence(F.lit(1), F.length("piece") - 1)
    parts = F.transform(
        cuts,
        lambda i: F.struct(
            F.left("piece", i).alias("prefix"), F.substring(F.col("piece"), i + 1, F.length("piece")).alias("suffix")
        ),
    )
    pairs = vocabulary.filter(F.length("piece") > 1).select(F.explode(parts).alias("p")).select("p.*")
    left = V.lookup(pairs, vocabulary.select(F.col("piece").alias("prefix")), "prefix")
    return V.lookup(left, vocabulary.select(F.col("piece").alias("suffix")), "suffix").select("prefix", "suffix")


def base_pieces(spark, sf):
    vocabulary = V.vocabulary(spark, sf)
    return L.base_pieces(_merges(vocabulary), vocabulary)


def base_piece_check(spark, sf):
    vocabulary = V.vocabulary(spark, sf)
    return L.base_piece_check(_merges(vocabulary), vocabulary)


def space_marker(spark, sf):
    pieces = V.documents(spark, sf).select(
        F.explode(F.regexp_extract_all("text", F.lit("( ?[^ ]+)"), F.lit(1))).alias("piece")
    )
    marked = pieces.select(F.translate("piece", " ", text.SPACE_MARKERS[2]).alias("piece"))
    return L.space_marker(marked)


def marked_terms(spark, sf):
    items = V.table(spark, sf, "benchmark")
    return items.select("item_id", text.with_marker(F.col("text"), F.lit(text.SPACE_MARKERS[2])).alias("term"))


def ws_canonical(spark, sf):
    return V.documents(spark, sf).select("doc_id", text.canonical_space(F.col("text")).alias("canonical"))


# --- runs ---------------------------------------------------------------------------------


def norm_names(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", text.norm(F.col("url")).alias("name"))


def parse_runs(spark, sf):
    return runs.parse_names(V.run_names(spark, sf))


def alias_longest(spark, sf):
    return runs.parse_names(V.run_names(spark, sf)).filter("model_alias IS NOT NULL").select("file", "model_alias")


def path_modes(spark, sf):
    return V.run_names(spark, sf).select("file", runs.mode(F.col("file")).alias("mode"))


def output_names(spark, sf):
    d = F.col("doc_id")
    return V.table(spark, sf, "documents").select(
        "doc_id",
        runs.output_name(
            F.col("source"),
            F.concat(F.lit("owner/Model-"), F.col("lang"), F.when(d % 2 == 0, "-Instruct").otherwise("")),
            d % 8 + 1,
            F.lit(42),
        ).alias("name"),
    )


def strip_prompt(spark, sf):
    rows = V.generations(V.docs_pii(spark, sf))
    return rows.select("idx", text.strip_prompt(F.col("prompt"), F.col("output")).alias("answer"))


def resolve_fields(spark, sf):
    records = V.json_records(spark, sf).withColumn("record", F.parse_json("value"))
    return records.select(
        "doc_id",
        fields.prompt_text(F.col("record")).alias("prompt"),
        fields.answer_text(F.col("record")).alias("output"),
    )


def _report(spark, sf):
    return runs.violation_report(
        V.files(spark, sf), V.generations(V.docs_pii(spark, sf)), _lex8(spark, T.EVAL)
    )


def violation_report(spark, sf):
    rate = F.when(~F.isnan("violation_rate"), F.round("violation_rate", 6))
    return _report(spark, sf).withColumn("violation_rate", rate)


def violation_report_grams(spark, sf):
    """The report with the lexicon as a join and records without an index."""
    records = V.generations(V.docs_pii(spark, sf)).withColumn("idx", F.lit(None).cast("bigint"))
    report = runs.violation_report(V.files(spark, sf), records, _lex8(spark, T.EVAL, 0))
    return report.withColumn("violation_rate", F.when(~F.isnan("violation_rate"), F.round("violation_rate", 6)))


def generations_roundtrip(spark, sf):
    """Records through the JSON lines sink and back."""
    path = shared_folder(spark, "generations")
    writers.write_generations(V.generations(V.docs_pii(spark, sf)), path)
    return readers.read_generations(spark, path, "*.json").select("idx", "prompt", "output")


def lexicon_roundtrip(spark, sf):
    """Matched spans through the JSON array sink, read as one of several lexicons and for evaluation."""
    path = shared_folder(spark, "lexicon")
    writers.write_json_lexicon(spans.distinct_spans(V.docs_pii(spark, sf)).withColumnRenamed("span", "term"), path)
    union, _ = readers.read_json_lexicons(spark, [path])
    evaluation = readers.read_evaluation_lexicon(spark, path)
    return union.select(F.lit("union").alias("reader"), "term").unionByName(
        evaluation.select(F.lit("evaluation").alias("reader"), "term")
    )


def lexicon_roundtrip_large(spark, sf):
    """Every distinct word of the corpus through the JSON array sink of any size and back, with its place in the file."""
    path = shared_folder(spark, "lexicon")
    writers.write_json_lines_lexicon(V.vocabulary(spark, sf).select(F.col("piece").alias("term")), path)
    return readers.read_json_lines_lexicon(spark, path)


def _results(spark, sf) -> DataFrame:
    """Outputs with the run that they belong to."""
    names = runs.parse_names(V.files(spark, sf)).filter("error IS NULL").select("file", *RUN)
    records = V.generations(V.docs_pii(spark, sf)).select("file", "idx", F.length("output").cast("bigint").alias("n_chars"))
    return lookup_join(records, names, "file").drop("file")


def results_roundtrip(spark, sf):
    """Results laid out by run; then the runs of one method and data set are written again, without their short outputs."""
    path = shared_folder(spark, "results")
    results = _results(spark, sf)
    writers.write_results(results, path)
    again = results.filter("method = 'ours' AND dataset = 'RTP' AND n_chars > 300").withColumn("n_chars", -F.col("n_chars"))
    writers.rewrite_runs(again, path)
    return readers.read_results(spark, path, "idx BIGINT, n_chars BIGINT").select(*RUN, "idx", "n_chars")


def list_files_roundtrip(spark, sf):
    """The listing of result files, one of which is empty."""
    path = shared_folder(spark, "listed")
    named = V.generations(V.documents(spark, sf)).select("file", F.lit("x").alias("value")).distinct()
    named.coalesce(1).write.partitionBy("file").text(path)
    named.filter("false").select("value").coalesce(1).write.text(f"{path}/file=ours_Enron_phi_4_16_42.jsonl")
    found = readers.list_files(spark, path, "file=*/*.txt")
    name = F.regexp_extract("file", "file=([^/]+)/", 1)
    return found.groupBy(name.alias("file")).agg(F.count("*").alias("n_files"), F.sum("length").alias("length"))


def report_roundtrip(spark, sf):
    """Report and rejects through the CSV sinks and back."""
    root = shared_folder(spark, "report")
    path = writers.write_report(_report(spark, sf), root)
    writers.write_rejects(runs.rejects(V.files(spark, sf)), f"{root}_rejects")
    numbers = "file STRING, method STRING, dataset STRING, model_alias STRING, batch_size STRING, seed STRING, mode STRING"
    numbers += ", total_examples BIGINT, violations BIGINT, violation_rate DOUBLE"
    report = spark.read.schema(numbers).option("header", True).csv(path)
    rejects = spark.read.schema("file STRING, error STRING").option("header", True).csv(f"{root}_rejects")
    rate = F.when(~F.isnan("violation_rate"), F.round("violation_rate", 6)).alias("violation_rate")
    columns = ["file", "method", "seed", "mode", "total_examples", "violations"]
    return report.select(*columns, rate, F.lit(None).cast("string").alias("error")).unionByName(
        rejects, allowMissingColumns=True
    )


def setting_throughput(spark, sf):
    """Tokens per second of each setting, as if a second took a hundred characters."""
    records = V.generations(V.docs_pii(spark, sf))
    log = records.select(
        "file",
        F.size(F.split("output", " ", -1)).cast("bigint").alias("new_tokens"),
        (F.length("output") / 100).alias("seconds"),
    )
    rates = runs.setting_throughput(V.files(spark, sf), log)
    return rates.select(
        "method",
        "dataset",
        "model_alias",
        "batch_size",
        "new_tokens",
        F.round("seconds", 3).alias("seconds"),
        F.round("tokens_per_second", 6).alias("tokens_per_second"),
        F.round("relative", 6).alias("relative"),
    )


def report_rejects(spark, sf):
    return runs.rejects(V.files(spark, sf))


def run_summary(spark, sf):
    summary = runs.run_summary(_report(spark, sf))
    return summary.withColumn("violation_rate", F.round("violation_rate", 6)).withColumn(
        "base_rate", F.round("base_rate", 6)
    )


def run_rollup(spark, sf):
    """Violation rates of each method, dataset and model, with subtotals."""
    totals = runs.run_rollup(_report(spark, sf))
    return totals.withColumn("violation_rate", F.round("violation_rate", 6))


def throughput(spark, sf):
    rates = runs.relative_throughput(V.run_log(spark, sf), "view")
    return rates.select(
        "run_id",
        "new_tokens",
        F.round("seconds", 3).alias("seconds"),
        F.round("tokens_per_second", 6).alias("tokens_per_second"),
        F.round("relative", 6).alias("relative"),
    )


def seeded_sample(spark, sf):
    return sampling.seeded_sample(V.table(spark, sf, "documents").select("doc_id"), "doc_id")


def batch_index(spark, sf):
    return running.batches(V.table(spark, sf, "documents").select("doc_id"), "doc_id", 16)


def batch_index_text(spark, sf):
    """Batches in the order of source and text hash: the first and last place of each pair, and how many rows it has."""
    docs = V.table(spark, sf, "documents").select("source", F.md5("text").alias("hash"))
    placed = running.batches_by(docs, ["source", "hash"], 16)
    return placed.groupBy("source", "hash").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min("batch_id").alias("first_batch"), F.count("*").alias("n")
    )


# --- token tables -------------------------------------------------------------------------


def _tokens(spark, sf):
    return V.tokens(V.docs_pii(spark, sf))


def token_scan_terms(spark, sf):
    found = sequences.first_term_completions(sequences.generated(_tokens(spark, sf)), _lex8(spark, T.ENFORCE))
    return found.select("seq_id", "pos")


def token_scan_terms_grams(spark, sf):
    found = sequences.first_term_completions(sequences.generated(_tokens(spark, sf)), _lex8(spark, T.ENFORCE, 0))
    return found.select("seq_id", "pos")


def token_scan_regex(spark, sf):
    return sequences.first_completions(sequences.generated(_tokens(spark, sf)))


def token_spans(spark, sf):
    docs = V.docs_pii(spark, sf)
    found = spans.spans(docs).withColumnRenamed("doc_id", "seq_id")
    tokens = sequences.with_offsets(V.tokens(docs))
    pairs = sequences.overlapping(tokens.select("seq_id", "pos", "start", "end"), found)
    return pairs.select("seq_id", F.col("token.pos").alias("pos"), F.col("span.ord").alias("ord"))


def tokens_until_end(spark, sf):
    marked = V.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("seq_id"),
        F.col("turn").alias("pos"),
        F.col("text").alias("piece"),
        (F.col("role") == "assistant").alias("is_eos"),
    )
    return sequences.until_end(marked).select("seq_id", "pos")


def running_position(spark, sf):
    kept = sequences.generated(_tokens(spark, sf))
    return running.position(kept.select("seq_id", F.col("pos").alias("at")), ["seq_id"], "at", "pos")


# --- candidates ---------------------------------------------------------------------------


def cand_logprob(spark, sf):
    scored = C.log_softmax(V.candidate_table(spark, sf))
    return scored.select("seq_id", "step", "cand", F.round("logprob", 6).alias("logprob"))


def cand_temp(spark, sf):
    scored = C.log_softmax(C.temperature(V.candidate_table(spark, sf), 0.7))
    return scored.select("seq_id", "step", "cand", F.round("logprob", 6).alias("logprob"))


def cand_topk(spark, sf):
    return C.top_k(V.candidate_table(spark, sf), 5).select("seq_id", "step", "cand")


def cand_topp(spark, sf):
    return C.top_p(V.candidate_table(spark, sf), 0.7531, k=20).select("seq_id", "step", "cand")


def cand_greedy(spark, sf):
    return C.greedy(V.candidates(spark, sf))


def cand_sample(spark, sf):
    return C.sample(V.candidates(spark, sf), 42)


def _blocked_candidates(spark, sf):
    """Candidates behind a clean context word, with the flag whether they complete a violation."""
    lex = _lex8(spark, T.ENFORCE)
    context, joined = F.col("seq_id"), F.concat_ws(" ", "seq_id", "cand")
    clean = ~(T.any_literal(lex, context) | P.has_match(context))
    return (
        V.candidates(spark, sf)
        .filter(clean)
        .withColumn("blocked", (T.any_literal(lex, joined) | P.has_match(joined)) & ~F.col("is_eos"))
    )


def cand_state_mask(spark, sf):
    """Candidates appended to their context word, blocked by the state the word leaves behind."""
    lex = _lex8(spark, T.ENFORCE)
    # A table: joins with lookups beyond the broadcast bound read it several times.
    kept = V.candidate_table(spark, sf).filter(~T.any_literal(lex, F.col("seq_id")))
    contexts = L.state_of(kept.withColumnRenamed("cand", "piece"), V.lexicon8(spark), "seq_id")
    # A mask is made once per vocabulary and read by every candidate table.
    table = written(L.state_table(V.lexicon8(spark), V.vocabulary(spark, sf)), "mask")
    masked = L.with_mask(contexts, table, V.END_PIECE)
    return masked.select("seq_id", F.col("piece").alias("cand"), "state", "blocked")


def cand_mask_audit(spark, sf):
    audit = C.mask_audit(_blocked_candidates(spark, sf))
    return audit.withColumn("removed_mass", F.round("removed_mass", 9))


def cand_masked_pick(spark, sf):
    """Original log-probability of the greedy choice under the mask."""
    candidates = written(_blocked_candidates(spark, sf), "candidates")
    picks = C.greedy(C.mask(candidates))
    return C.chosen_logprob(candidates, picks).withColumn("logprob", F.round("logprob", 6))


def _candidate_constraints(spark):
    rows = [(t, i, "term", t, -1.5) for i, t in enumerate(V.LEXICON8)]
    rows += [(p.name, 100 + i, "regex", p.regex, C.NEG_INF_CONST) for i, p in enumerate(P.PII)]
    rows += [("shout", 200, "regex", "!", -0.25)]
    return spark.createDataFrame(rows, K.CONSTRAINTS)


def _finite_score(scored):
    score = F.round(F.when(F.col("score") > C.NEG_INF_THRESH, F.col("score")), 6)
    return scored.select(*C.STEP, "cand", score.alias("score"))


def cand_soft_penalty(spark, sf):
    texts = V.candidates(spark, sf).withColumn("text", F.concat_ws(" ", "seq_id", "cand"))
    punished = K.with_penalty(texts, _candidate_constraints(spark))
    return _finite_score(
        punished.withColumn("score", C.soft_score(F.col("logit"), F.col("penalty"), F.col("is_eos")))
    )


def cand_penalty_join(spark, sf):
    """The same scores from a table of penalties, one row per candidate and violated constraint."""
    # A table: it is read for the penalties and for the scores, and more often where the penalties exceed the broadcast bound.
    candidates = V.candidate_table(spark, sf)
    texts = candidates.select(
        F.struct(*C.STEP, "cand").alias("k"), F.concat_ws(" ", "seq_id", "cand").alias("text")
    )
    penalties = K.hits(texts, _candidate_constraints(spark), "k").select("k.*", "penalty")
    return _finite_score(C.penalised(candidates, penalties))


def constraint_modes(spark, sf):
    """Constraints violated per document, each term under all three ways of comparing."""
    rows = [(f"{m}:{t}", i, "term", f" {t}" if m == T.EVAL else t.upper() if m == T.SELECT else t, -1.0, m)
            for m in K.MODES for i, t in enumerate(V.LEXICON8)]
    table = spark.createDataFrame(rows, K.CONSTRAINTS + ", match_mode STRING")
    return K.hits(V.documents(spark, sf), table).select("doc_id", "constraint_id")


def violated_constraints(spark, sf):
    """Constraints violated per document and their summed penalties."""
    rows = [(t, i, "term", t, -1.5) for i, t in enumerate(V.LEXICON8)]
    rows += [(p.name, 100 + i, "regex", p.regex, -10.0) for i, p in enumerate(P.PII)]
    return K.merged(V.docs_pii(spark, sf), spark.createDataFrame(rows, K.CONSTRAINTS))


def constraint_regex_index(spark, sf):
    """Thousands of expressions at once."""
    return K.hits(V.documents(spark, sf), V.word_expressions(spark, sf)).select("doc_id", "constraint_id")


def nbest_clean(spark, sf):
    outputs = V.nbest(spark, sf)
    clean = spans.clean(T.without(outputs, _lex8(spark, T.ENFORCE), text="output"), text="output")
    best = C.best_completions(clean.select("prompt_id", "gen_id", "sum_logprob"), 3)
    return best.select("prompt_id", "gen_id", "rank")


# Shares in which the pairs of words of all texts are scored.
PAIR_SHARES = 4


def seq_perplexity(spark, sf):
    """Texts as sequences, each word scored as a candidate behind the word before it."""
    w, n = F.col("w"), F.size("w")
    pairs = F.arrays_zip(F.slice(w, F.lit(1), n - 1).alias("c"), F.slice(w, F.lit(2), n - 1).alias("s"))
    steps = V.words(spark, sf).filter("size(w) > 1").select("doc_id", F.explode(pairs).alias("p"))
    steps = steps.select("doc_id", F.col("p.c").alias("seq_id"), F.col("p.s").alias("cand"))
    scored = C.log_softmax(V.candidate_table(spark, sf)).filter("NOT is_eos").select("seq_id", "cand", "logprob", F.exp("logit").alias("n"))
    scored = written(scored, "scored")
    # The pairs of all texts are many times the texts: a share of them at a time is shuffled, and what it took is freed.
    share = F.pmod(F.xxhash64("seq_id", "cand"), F.lit(PAIR_SHARES))
    chosen = [lookup_join(steps.filter(share == k), scored.filter(share == k), ["seq_id", "cand"], often="n") for k in range(PAIR_SHARES)]
    scores = C.sequence_scores(*[part.select(F.col("doc_id").alias("seq_id"), "logprob") for part in chosen])
    return scores.select(
        F.col("seq_id").alias("doc_id"),
        "n_tokens",
        F.round("score", 4).alias("score"),
        F.round("perplexity", 4).alias("perplexity"),
    )


def sql_functions(spark, sf):
    """The registered SQL functions in a SQL query."""
    sql.register(spark)
    return spark.sql(
        """SELECT doc_id, norm_name(source) AS name, strip_prompt(substring(text, 1, 30), text) AS answer,
             path_mode(concat(source, '/', CASE WHEN doc_id % 2 = 0 THEN 'RTP' ELSE 'En-ron' END)) AS mode,
             pii_reason(text) AS reason, pii_completion_end(text) AS end_first, pii_redact(text, '[PII]') AS redacted
           FROM {docs}""",
        docs=V.documents(spark, sf, "source"),
    )


# --- streams ------------------------------------------------------------------------------


def _arriving_documents(spark, sf) -> DataFrame:
    """The table's file, or all part files where it is a folder: a stream takes a single file by a glob path only."""
    return readers.stream(spark, f"{sf}/documents.parque[t]", "doc_id BIGINT, text STRING")


def stream_filter(spark, sf):
    docs = _arriving_documents(spark, sf)
    return alerts.drain(alerts.violating(docs).select("doc_id"))


def stream_filter_terms(spark, sf):
    """A stream against the lexicon as a join."""
    docs = _arriving_documents(spark, sf)
    out = shared_folder(spark, "alerts")
    alerts.write_term_alerts(docs, _lex8(spark, T.ENFORCE, 0), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("doc_id BIGINT").parquet(f"{out}/data").select("doc_id")


def _sent(spark, chunks: DataFrame) -> tuple[str, int]:
    """Chunks in files, those of a sequence in many, with the number of files that are half of all: a stream that takes so many at a time
    meets chunks out of order. There are as many files as a shuffle has tasks."""
    source = shared_folder(spark, "chunks")
    files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks.repartition(files, "seq_id", "chunk_no").write.parquet(source)
    return source, (files + 1) // 2


def stream_scan(spark, sf):
    source, half = _sent(spark, V.chunks(V.docs_pii(spark, sf)))
    schema = "seq_id BIGINT, chunk_no INT, piece STRING, is_last BOOLEAN"
    arriving = readers.stream(spark, source, schema, files_per_trigger=half)
    found = alerts.drain(chunks.first_completions(arriving))
    return found.select("seq_id", F.col("end").alias("end_first"))


TIMED = "seq_id BIGINT, chunk_no INT, piece STRING, is_last BOOLEAN, sent TIMESTAMP"


def _arriving(spark, sent: DataFrame) -> DataFrame:
    """Chunks out of order, and behind them a heartbeat."""
    source, half = _sent(spark, sent)
    V.heartbeat(spark).select(*sent.columns).write.mode("append").parquet(source)
    return readers.stream(spark, source, TIMED, files_per_trigger=half)


def stream_scan_gaps(spark, sf):
    """First violations where chunks are lost; the loss is reported."""
    with ordered.rocksdb(spark):
        arriving = _arriving(spark, V.lossy_chunks(V.docs_pii(spark, sf)))
        found = alerts.drain(ordered.first_completions(arriving, "1 day"))
    return found.select("seq_id", "kind", F.col("end").alias("end_first"), F.when(F.col("kind") == "gap", F.col("chunk_no")).alias("gap_from"), F.col("upto").alias("gap_to"))


def stream_scan_terms(spark, sf):
    """First terms of a lexicon of any size, also across the borders of chunks."""
    out = shared_folder(spark, "alerts")
    with ordered.rocksdb(spark):
        arriving = _arriving(spark, V.timed_chunks(V.documents(spark, sf)))
        alerts.write_term_completions(arriving, _lex8(spark, T.ENFORCE, 0), f"{out}/data", f"{out}/checkpoint", delay="1 day").awaitTermination()
    return spark.read.schema("seq_id BIGINT, end BIGINT").parquet(f"{out}/data").select("seq_id", F.col("end").alias("end_first"))


QUERIES = [
    pii_by_pattern,
    pii_select,
    pii_first_reason,
    pii_reason_counts,
    pii_spans,
    pii_spans_distinct,
    pii_first_completion,
    pii_clean_prefix,
    pii_redact,
    redact_all,
    pii_clean_docs,
    span_lexicon,
    stage_counts,
    page_spans,
    source_flags,
    lexicon_lines,
    lexicon_union,
    toxic_select,
    toxic_eval,
    toxic_raw,
    toxic_select_grams,
    toxic_raw_grams,
    term_counts,
    word_doc_counts,
    word_raw_counts,
    span_term_docs,
    clean_docs,
    lexicon_states,
    lexicon_failure,
    lexicon_forbidden,
    redundant_terms,
    minimal_terms,
    vocab_state_mask,
    vocab_blocked,
    base_pieces,
    base_piece_check,
    space_marker,
    marked_terms,
    ws_canonical,
    norm_names,
    parse_runs,
    alias_longest,
    path_modes,
    output_names,
    strip_prompt,
    resolve_fields,
    violation_report,
    violation_report_grams,
    generations_roundtrip,
    lexicon_roundtrip,
    lexicon_roundtrip_large,
    results_roundtrip,
    list_files_roundtrip,
    report_roundtrip,
    setting_throughput,
    report_rejects,
    run_summary,
    run_rollup,
    throughput,
    seeded_sample,
    batch_index,
    batch_index_text,
    token_scan_terms,
    token_scan_terms_grams,
    token_scan_regex,
    token_spans,
    tokens_until_end,
    running_position,
    cand_logprob,
    cand_temp,
    cand_topk,
    cand_topp,
    cand_greedy,
    cand_sample,
    cand_state_mask,
    cand_mask_audit,
    cand_masked_pick,
    cand_soft_penalty,
    cand_penalty_join,
    constraint_modes,
    violated_constraints,
    constraint_regex_index,
    nbest_clean,
    seq_perplexity,
    sql_functions,
    stream_filter,
    stream_filter_terms,
    stream_scan,
    stream_scan_gaps,
    stream_scan_terms,
]
