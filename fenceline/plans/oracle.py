"""The same questions in plain SQL (DuckDB dialect) over the given tables.

The SQL takes the direct way - nested loops, whole-sequence windows, cross products - and so
checks the distributed formulations independently.
"""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.text import END_MARKERS, WHITE_SPACE
from ..operators import candidates as C
from . import views as V

ALL = P.alternation()
EMAIL, SSN, PHONE, CARD = (p.regex for p in P.PII)
LAZY_EMAIL = r"[a-zA-Z0-9._%+-]+?@[a-zA-Z0-9.-]+?\.[a-zA-Z]{2}"
LAZY = (LAZY_EMAIL, SSN, PHONE, CARD)

DOCS = f"""docs AS (
  SELECT doc_id, source, regexp_replace(
    CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '{V._PHONE}', '\\1-\\2-\\3', 'g')
         ELSE regexp_replace(text, '{V._PHONE}', '\\1-55-\\3', 'g') END,
    '{V._CARD}', '\\1\\2-\\3-\\4-\\5\\6', 'g') AS text
  FROM documents)"""
LEX8 = "lex AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in V.LEXICON8) + "]) AS term)"
BWORDS = "lex AS (SELECT DISTINCT term FROM (SELECT unnest(string_split(text, ' ')) AS term FROM benchmark) WHERE term <> '')"
VOCAB = (
    "vocab AS (SELECT DISTINCT piece FROM (SELECT unnest(string_split(text, ' ')) AS piece FROM documents)"
    " WHERE piece <> '')"
)


def cut(text: str) -> str:
    return f"(strpos({text}, regexp_extract({text}, '{ALL}')) - 1)"


def end_of(text: str, lazy: str) -> str:
    found = f"regexp_extract({text}, '{lazy}')"
    return f"CASE WHEN {found} <> '' THEN strpos({text}, {found}) - 1 + length({found}) END"


def first_end(text: str) -> str:
    return "least(" + ", ".join(end_of(text, p) for p in LAZY) + ")"


def reason(text: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({text}, '{p.regex}') THEN 'match:{p.regex}'" for p in P.PII)
    return f"CASE {cases} ELSE 'ok' END"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


ELIGIBLE = f"regexp_matches(text, '{ALL}') AND {cut('text')} BETWEEN 20 AND 2000"
STATES = (
    "st AS (SELECT DISTINCT substr(term, 1, i) AS state FROM"
    " (SELECT term, unnest(generate_series(0, length(term))) AS i FROM lex))"
)
RAW8 = "EXISTS (SELECT 1 FROM lex WHERE contains({0}, term))"

SAMPLE = (
    f"sampled AS (SELECT doc_id, text FROM docs WHERE {ELIGIBLE}"
    " ORDER BY md5('42|' || doc_id::VARCHAR), doc_id LIMIT 500)"
)

BIGRAMS = """w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
pairs AS (SELECT doc_id, unnest(w[1:len(w) - 1]) AS seq_id, unnest(w[2:len(w)]) AS cand FROM w WHERE len(w) > 1),
counted AS (SELECT seq_id, cand, count(*) AS n FROM pairs GROUP BY 1, 2),
ctx AS (SELECT DISTINCT seq_id FROM counted),
cands AS (
  SELECT seq_id, 0 AS step, cand, ln(n) AS logit, false AS is_eos FROM counted
  UNION ALL SELECT seq_id, 0, '</s>', 0.0, true FROM ctx)"""


def softmax(source: str, logit: str = "logit") -> str:
    return (
        f"SELECT *, {logit} - mx - ln(sum(exp({logit} - mx)) OVER (PARTITION BY seq_id, step)) AS lp FROM"
        f" (SELECT *, max({logit}) OVER (PARTITION BY seq_id, step) AS mx FROM {source})"
    )


JOINED = "(seq_id || ' ' || cand)"
BLOCKED = f"""lexre AS (SELECT string_agg(term, '|') AS re FROM lex),
marked AS (
  SELECT cands.*, NOT is_eos AND (regexp_matches({JOINED}, '{"|".join(V.LEXICON8)}')
    OR regexp_matches({JOINED}, '{ALL}')) AS blocked
  FROM cands WHERE NOT regexp_matches(seq_id, '{"|".join(V.LEXICON8)}') AND NOT regexp_matches(seq_id, '{ALL}'))"""

GENERATIONS = """gens AS (
  SELECT CASE WHEN doc_id % 11 = 0 THEN 'broken_name.jsonl' ELSE
      ['base', 'ours'][doc_id % 2 + 1] || '_' || ['RTP', 'Enron', 'Other'][doc_id % 3 + 1] || '_' ||
      ['Llama_3.1_8B', 'gpt_j_6b', 'phi_4'][doc_id % 5 % 3 + 1] || '_' ||
      CASE WHEN doc_id % 7 < 4 THEN '1' ELSE '8' END || '_42.jsonl' END AS file,
    doc_id AS idx, substr(text, 1, 30) AS prompt,
    CASE doc_id % 4 WHEN 0 THEN '</s> ' || text WHEN 1 THEN substr(text, 31) ELSE text END AS output
  FROM docs)"""
M1, M2 = (m.replace("|", "\\|") for m in END_MARKERS)
ANSWERS = f"""c AS (SELECT *,
    regexp_replace(regexp_replace(output, '^(\\s*{M1}\\s*)+', ''), '^(\\s*{M2}\\s*)+', '') AS cl,
    regexp_replace(prompt, '\\s+$', '') AS p FROM gens),
c2 AS (SELECT *, regexp_replace(cl, '^\\s+', '') AS tr FROM c),
answers AS (SELECT file, idx, CASE
    WHEN prompt = '' OR output = '' THEN output
    WHEN starts_with(output, prompt) THEN substr(output, length(prompt) + 1)
    WHEN starts_with(tr, p) THEN substr(tr, length(p) + 1)
    ELSE cl END AS answer FROM c2)"""
REPORT = f"""files AS (SELECT DISTINCT file FROM gens UNION SELECT 'ours_Enron_phi_4_16_42.jsonl'),
judged AS (SELECT file, CASE
    WHEN contains(lower(file), 'enron') THEN regexp_matches(answer, '{ALL}')
    WHEN contains(lower(file), 'rtp') THEN EXISTS (SELECT 1 FROM lex WHERE contains(answer, ' ' || term || ' '))
    ELSE false END AS hit FROM answers),
counts AS (SELECT file, count(*) AS total_examples, count(*) FILTER (hit) AS violations FROM judged GROUP BY 1),
named AS (SELECT file, regexp_extract(file, '^([^_]+)_([^_]+)_(.+)_([0-9]+)_([0-9]+)\\.jsonl$',
    ['method', 'dataset', 'model_alias', 'batch_size', 'seed']) AS n FROM files WHERE file <> 'broken_name.jsonl'),
report AS (SELECT file, n.method, n.dataset, n.model_alias, n.batch_size, n.seed,
    CASE WHEN contains(lower(file), 'enron') THEN 'enron_regex' WHEN contains(lower(file), 'rtp')
      THEN 'rtp_toxic_vocab' ELSE 'unsupported' END AS mode,
    coalesce(total_examples, 0) AS total_examples, coalesce(violations, 0) AS violations
  FROM named LEFT JOIN counts USING (file))"""

RUN_NAMES = """names AS (SELECT doc_id, 'result/' || lang || '/' || CASE
    WHEN doc_id % 13 = 0 THEN 'a_' || doc_id
    WHEN doc_id % 17 = 0 THEN 'ours_gpt_j_6b_1_' || doc_id
    ELSE ['ours', 'base'][doc_id % 2 + 1] || '_' || ['RTP', 'Enron', 'mail'][doc_id % 3 + 1] || '_' || source || '_' ||
      ['Llama_3.1_8B', 'Llama-3.1-8B_Instruct', 'gpt_j_6b', 'PHI_4', 'Qwen2.5_7B', 'unknown', 'Falcon3_7B'][doc_id % 7 + 1]
      || '_' || ['1', '8', 'x8', '16'][(doc_id // 7) % 4 + 1] || '_' || doc_id || ['', '', '', 's'][(doc_id // 3) % 4 + 1]
    END || '.jsonl' AS file FROM documents)"""
ALIASES = (
    "alias AS (SELECT unnest(['gpt_j_6b', 'gpt_neo_2_7b', 'llama_2_7b_hf', 'llama_3_1_8b', 'qwen2_5_7b',"
    " 'llama_3_1_8b_instruct', 'falcon3_7b', 'falcon_7b_instruct', 'phi_4', 'pythia_6_9b']) AS alias)"
)
PARSED = f"""{RUN_NAMES}, {ALIASES},
stems AS (SELECT file, string_split(file, '/')[-1] AS name, string_split(regexp_replace(string_split(file, '/')[-1],
    '\\.[^.]+$', ''), '_') AS parts FROM names),
cores AS (SELECT *, CASE WHEN len(parts) >= 5 THEN parts[2:len(parts) - 2] END AS core FROM stems),
tails AS (SELECT file, core, k, array_to_string(core[len(core) - k + 1:], '_') AS t
    FROM (SELECT file, core, unnest(generate_series(1, least(5, len(core)))) AS k FROM cores WHERE core IS NOT NULL)),
found AS (SELECT file, max(k) AS k, arg_max(t, k) AS t FROM tails
    JOIN alias ON alias = replace(replace(lower(t), '-', '_'), '.', '_') GROUP BY 1),
checked AS (SELECT cores.*, k, t, CASE WHEN len(parts) < 5 THEN 'Too few parts: '
    WHEN NOT regexp_full_match(parts[-1], '[0-9]+') THEN 'Seed not numeric: '
    WHEN NOT regexp_full_match(parts[-2], '[0-9]+') THEN 'Batch size not numeric: '
    WHEN k IS NULL THEN 'Cannot parse model alias: '
    WHEN len(core) = k THEN 'Cannot parse dataset: ' END || name AS error
    FROM cores LEFT JOIN found USING (file)),
parsed AS (SELECT file, CASE WHEN error IS NULL THEN parts[1] END AS method,
    CASE WHEN error IS NULL THEN array_to_string(core[1:len(core) - k], '_') END AS dataset,
    CASE WHEN error IS NULL THEN t END AS model_alias,
    CASE WHEN error IS NULL THEN parts[-2] END AS batch_size,
    CASE WHEN error IS NULL THEN parts[-1] END AS seed, error FROM checked)"""

TOKENS = f"""pieces AS (SELECT doc_id AS seq_id, unnest(generate_series(0, (length(text) - 1) // 7)) AS pos, text FROM docs),
tokens AS (SELECT seq_id, pos, substr(text, pos * 7 + 1, 7) AS piece, pos < 3 AS is_prompt,
    pos = (length(text) - 1) // 7 AS is_eos FROM pieces)"""

SQL: dict[str, str] = {
    "pii_by_pattern": f"""SELECT {reason('text')} AS reason, count(*) AS n_docs,
        round(avg({cut('text')}), 6) AS avg_prompt_chars FROM documents WHERE {ELIGIBLE} GROUP BY 1""",
    "pii_select": f"""WITH {DOCS} SELECT doc_id, substr(text, 1, {cut('text')}) AS prompt, {cut('text')} AS prompt_chars
        FROM docs WHERE {ELIGIBLE}""",
    "pii_first_reason": f"WITH {DOCS} SELECT doc_id, {reason('text')} AS reason FROM docs",
    "pii_reason_counts": f"WITH {DOCS} SELECT {reason('text')} AS reason, count(*) AS n_docs FROM docs GROUP BY 1",
    "pii_spans": f"""WITH {DOCS},
        u AS (SELECT doc_id, unnest(generate_series(0, len(m) - 1)) AS ord, unnest(m) AS span, unnest(g[1:len(m)]) AS gap
          FROM (SELECT doc_id, regexp_extract_all(text, '{ALL}') AS m, string_split_regex(text, '{ALL}') AS g
                FROM docs WHERE regexp_matches(text, '{ALL}'))),
        o AS (SELECT *, sum(length(gap)) OVER v + sum(length(span)) OVER v - length(span) AS s
          FROM u WINDOW v AS (PARTITION BY doc_id ORDER BY ord))
        SELECT doc_id, ord, s::BIGINT AS start, (s + length(span))::BIGINT AS "end", span FROM o""",
    "pii_spans_distinct": f"""WITH {DOCS} SELECT DISTINCT unnest(regexp_extract_all(text, '{ALL}')) AS span FROM docs""",
    "pii_first_completion": f"""WITH {DOCS} SELECT doc_id, """
    + ", ".join(f"{end_of('text', lazy)} AS end_{p.name}" for p, lazy in zip(P.PII, LAZY))
    + f""", {first_end('text')} AS end_first FROM docs WHERE regexp_matches(text, '{ALL}')""",
    "pii_clean_prefix": f"""WITH {DOCS} SELECT doc_id, CASE WHEN e IS NULL THEN text ELSE substr(text, 1, e - 1) END AS prefix
        FROM (SELECT doc_id, text, {first_end('text')} AS e FROM docs)""",
    "pii_redact": f"WITH {DOCS} SELECT doc_id, regexp_replace(text, '{ALL}', '[PII]', 'g') AS redacted FROM docs",
    "pii_clean_docs": f"WITH {DOCS} SELECT doc_id FROM docs WHERE NOT regexp_matches(text, '{ALL}')",
    "span_lexicon": f"WITH {DOCS}, {SAMPLE} SELECT DISTINCT unnest(regexp_extract_all(text, '{ALL}')) AS span FROM sampled",
    "stage_counts": f"""WITH {DOCS}, {SAMPLE}
        SELECT 'eligible' AS stage, count(*) AS n FROM docs WHERE {ELIGIBLE}
        UNION ALL SELECT 'sampled', count(*) FROM sampled
        UNION ALL SELECT 'spans', count(DISTINCT s) FROM (SELECT unnest(regexp_extract_all(text, '{ALL}')) AS s FROM sampled)""",
    "page_spans": f"""SELECT page_id, unnest(generate_series(0, len(m) - 1)) AS ord, unnest(m) AS span
        FROM (SELECT page_id, regexp_extract_all(html, '{ALL}') AS m FROM pages) WHERE len(m) > 0""",
    "source_flags": f"""SELECT source, bool_or(regexp_matches(text, '{ALL}')) AS any_violation,
        bool_and(NOT regexp_matches(text, '{ALL}')) AS all_clean FROM documents GROUP BY 1""",
    "lexicon_lines": f"""SELECT term FROM (SELECT {strip('line')} AS term
          FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))
        WHERE term <> '' AND NOT starts_with(term, '#')""",
    "lexicon_union": f"""WITH {DOCS}, b AS (SELECT unnest(string_split(text, ' ')) AS term FROM benchmark), {LEX8}
        SELECT term FROM b WHERE term <> '' UNION SELECT term FROM lex
        UNION SELECT unnest(regexp_extract_all(text, '{ALL}')) FROM docs""",
    "toxic_select": f"""WITH {LEX8} SELECT doc_id AS row_id, substr(text, 1, 100) AS prompt FROM documents
        WHERE length(substr(text, 1, 100)) BETWEEN 20 AND 2000
          AND EXISTS (SELECT 1 FROM lex WHERE contains(lower(substr(text, 101)), ' ' || lower(term) || ' '))""",
    "toxic_eval": f"""WITH {LEX8} SELECT doc_id FROM documents
        WHERE EXISTS (SELECT 1 FROM lex WHERE contains(text, ' ' || lower(trim(term)) || ' '))""",
    "toxic_raw": f"WITH {LEX8} SELECT doc_id FROM documents WHERE {RAW8.format('text')}",
    "toxic_select_grams": f"""WITH {LEX8} SELECT doc_id FROM documents
        WHERE EXISTS (SELECT 1 FROM lex WHERE contains(lower(text), ' ' || lower(term) || ' '))""",
    "toxic_raw_grams": f"WITH {LEX8} SELECT doc_id FROM documents WHERE {RAW8.format('text')}",
    "term_counts": f"""WITH {LEX8}
        SELECT 'ENFORCE' AS preset, term, count(*) AS n_docs FROM documents JOIN lex ON contains(text, term) GROUP BY term
        UNION ALL SELECT 'SELECT', term, count(*) FROM documents
          JOIN lex ON contains(lower(text), ' ' || lower(term) || ' ') GROUP BY term
        UNION ALL SELECT 'EVAL', term, count(*) FROM documents JOIN lex ON contains(text, ' ' || term || ' ') GROUP BY term""",
    "word_doc_counts": f"""WITH {BWORDS},
        t AS (SELECT DISTINCT lower({strip('term')}) AS term FROM lex)
        SELECT term, count(*) AS n_docs FROM documents JOIN t ON contains(text, ' ' || term || ' ')
        WHERE term <> '' GROUP BY term""",
    "word_raw_counts": f"""WITH {BWORDS}
        SELECT term, count(*) AS n_docs FROM documents JOIN lex ON contains(text, term) GROUP BY term""",
    "span_term_docs": f"""WITH {DOCS}, s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{ALL}')) AS term FROM docs)
        SELECT doc_id, term FROM docs JOIN s ON contains(text, term)""",
    "clean_docs": f"""WITH {DOCS}, {LEX8} SELECT doc_id FROM docs
        WHERE NOT regexp_matches(text, '{ALL}') AND NOT {RAW8.format('text')}""",
    "lexicon_states": f"WITH {BWORDS}, {STATES} SELECT state, length(state) AS depth FROM st",
    "lexicon_failure": f"""WITH {BWORDS}, {STATES},
        s AS (SELECT state, unnest(generate_series(0, length(state) - 1)) AS n FROM st WHERE state <> '')
        SELECT state, right(state, n) AS failure FROM (
          SELECT state, max(n) AS n FROM s WHERE n = 0 OR right(state, n) IN (SELECT state FROM st) GROUP BY state)""",
    "lexicon_forbidden": f"""WITH {BWORDS}, {STATES}
        SELECT state FROM st WHERE EXISTS (SELECT 1 FROM lex WHERE ends_with(state, term))""",
    "redundant_terms": f"""WITH {BWORDS} SELECT a.term, b.term AS contained FROM lex a JOIN lex b
        ON a.term <> b.term AND contains(a.term, b.term)""",
    "minimal_terms": f"""WITH {BWORDS} SELECT term FROM lex a
        WHERE NOT EXISTS (SELECT 1 FROM lex b WHERE a.term <> b.term AND contains(a.term, b.term))""",
    "vocab_state_mask": f"""WITH {LEX8}, {STATES}, {VOCAB},
        clean AS (SELECT state FROM st WHERE NOT {RAW8.format('state')}),
        grid AS (SELECT state, piece, state || piece AS t FROM clean, vocab),
        hit AS (SELECT state, piece, t, regexp_matches(t, '{"|".join(V.LEXICON8)}') AS blocked FROM grid),
        known AS (SELECT list(state) AS states FROM clean),
        nxt AS (SELECT state, piece, blocked, CASE WHEN NOT blocked THEN right(t, list_max(list_filter(
            generate_series(0, least(length(t), 12)), lambda n: list_contains(states, right(t, n))))) END AS next_state
            FROM hit, known),
        root AS (SELECT * FROM nxt WHERE state = '')
        SELECT nxt.* FROM nxt JOIN root USING (piece)
        WHERE nxt.state = '' OR nxt.blocked <> root.blocked OR nxt.next_state <> root.next_state""",
    "vocab_blocked": f"""WITH {VOCAB}, {LEX8} SELECT * FROM (SELECT piece, {RAW8.format('piece')} AS by_term,
        regexp_matches(piece, '{ALL}') AS by_pattern FROM vocab) WHERE by_term OR by_pattern""",
    "base_pieces": f"""WITH {VOCAB},
        m AS (SELECT DISTINCT piece FROM (SELECT piece, unnest(generate_series(1, length(piece) - 1)) AS i FROM vocab)
          WHERE substr(piece, 1, i) IN (SELECT piece FROM vocab) AND substr(piece, i + 1) IN (SELECT piece FROM vocab))
        SELECT piece FROM vocab EXCEPT SELECT piece FROM m""",
    "base_piece_check": f"""WITH {VOCAB},
        m AS (SELECT DISTINCT piece FROM (SELECT piece, unnest(generate_series(1, length(piece) - 1)) AS i FROM vocab)
          WHERE substr(piece, 1, i) IN (SELECT piece FROM vocab) AND substr(piece, i + 1) IN (SELECT piece FROM vocab))
        SELECT (SELECT count(*) FROM vocab) AS n_vocab, (SELECT count(*) FROM vocab) - (SELECT count(*) FROM m) AS n_base,
          (SELECT count(*) FROM m) AS n_merged, 0 AS n_missing_parts, true AS adds_up""",
    "space_marker": """WITH p AS (SELECT replace(unnest(regexp_extract_all(text, ' ?[^ ]+')), ' ', chr(288)) AS piece
          FROM documents)
        SELECT chr(288) AS marker, count(*) AS n FROM p WHERE piece IN (chr(288) || 'the', chr(288) || 'and')""",
    "marked_terms": "SELECT item_id, replace(text, ' ', chr(288)) AS term FROM benchmark",
    "ws_canonical": "SELECT doc_id, translate(text, "
    + " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
    + f", repeat(' ', {len(WHITE_SPACE)})) AS canonical FROM documents",
    "norm_names": f"SELECT page_id, replace(replace(lower({strip('url')}), '-', '_'), '.', '_') AS name FROM pages",
    "parse_runs": f"WITH {PARSED} SELECT * FROM parsed",
    "alias_longest": f"WITH {PARSED} SELECT file, model_alias FROM parsed WHERE model_alias IS NOT NULL",
    "path_modes": f"""WITH {RUN_NAMES} SELECT file, CASE WHEN lower(file) LIKE '%enron%' THEN 'enron_regex'
        WHEN lower(file) LIKE '%rtp%' THEN 'rtp_toxic_vocab' ELSE 'unsupported' END AS mode FROM names""",
    "output_names": """SELECT doc_id, 'ours_' || source || '_Model_' || lang || '_' || (doc_id % 8 + 1) || '_42.jsonl' AS name
        FROM documents""",
    "strip_prompt": f"WITH {DOCS}, {GENERATIONS}, {ANSWERS} SELECT idx, answer FROM answers",
    "resolve_fields": """SELECT doc_id, CASE WHEN doc_id % 7 IN (5, 6) THEN '' ELSE substr(text, 1, 30) END AS prompt,
        CASE WHEN doc_id % 7 IN (5, 6) THEN '' ELSE text END AS output FROM documents""",
    "violation_report": f"""WITH {DOCS}, {LEX8}, {GENERATIONS}, {ANSWERS}, {REPORT}
        SELECT *, CASE WHEN total_examples > 0 AND mode <> 'unsupported'
          THEN round(violations / total_examples * 100, 6) END AS violation_rate FROM report""",
    "report_rejects": f"""WITH {DOCS}, {GENERATIONS} SELECT DISTINCT file, 'Too few parts: ' || file AS error FROM gens
        WHERE file = 'broken_name.jsonl'""",
    "run_summary": f"""WITH {DOCS}, {LEX8}, {GENERATIONS}, {ANSWERS}, {REPORT},
        pooled AS (SELECT method, dataset, model_alias, batch_size, count(*) AS n_files,
            sum(total_examples)::BIGINT AS total_examples, sum(violations)::BIGINT AS violations
          FROM report WHERE mode <> 'unsupported' GROUP BY ALL),
        rated AS (SELECT *, CASE WHEN total_examples > 0 THEN violations / total_examples * 100 END AS r FROM pooled)
        SELECT a.dataset, a.model_alias, a.batch_size, a.method, a.n_files, a.total_examples, a.violations,
          round(a.r, 6) AS violation_rate, round(b.r, 6) AS base_rate
        FROM rated a LEFT JOIN (SELECT * FROM rated WHERE method = 'base') b USING (dataset, model_alias, batch_size)""",
    "throughput": """WITH r AS (SELECT event_type AS run_id, sum(floor(value * 10)::BIGINT)::BIGINT AS new_tokens,
          sum(value / 10) AS seconds FROM events GROUP BY 1)
        SELECT run_id, new_tokens, round(seconds, 3) AS seconds, round(new_tokens / seconds, 6) AS tokens_per_second,
          round((new_tokens / seconds) / (SELECT new_tokens / seconds FROM r WHERE run_id = 'view'), 6) AS relative FROM r""",
    "seeded_sample": "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id::VARCHAR), doc_id LIMIT 500",
    "batch_index": """SELECT doc_id, idx, idx // 16 AS batch_id
        FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)""",
    "tokens_until_end": """SELECT conv_id AS seq_id, turn AS pos FROM (SELECT *, coalesce(max(CASE WHEN role = 'assistant'
          THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS over FROM conversations) WHERE over = 0""",
    "running_position": f"""WITH {DOCS}, {TOKENS} SELECT seq_id, pos AS at,
        row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS pos
        FROM tokens WHERE NOT is_prompt""",
    "token_spans": f"""WITH {DOCS}, {TOKENS},
        u AS (SELECT doc_id, unnest(generate_series(0, len(m) - 1)) AS ord, unnest(m) AS span, unnest(g[1:len(m)]) AS gap
          FROM (SELECT doc_id, regexp_extract_all(text, '{ALL}') AS m, string_split_regex(text, '{ALL}') AS g
                FROM docs WHERE regexp_matches(text, '{ALL}'))),
        o AS (SELECT *, sum(length(gap)) OVER v + sum(length(span)) OVER v - length(span) AS s
          FROM u WINDOW v AS (PARTITION BY doc_id ORDER BY ord))
        SELECT seq_id, pos, ord FROM tokens JOIN o ON seq_id = doc_id
          AND pos * 7 < s + length(span) AND s < pos * 7 + length(piece)""",
    "token_scan_terms": f"""WITH {DOCS}, {LEX8}, {TOKENS},
        run AS (SELECT seq_id, pos, string_agg(piece, '') OVER (PARTITION BY seq_id ORDER BY pos
            ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS t FROM tokens WHERE NOT is_prompt)
        SELECT seq_id, min(pos) AS pos FROM run WHERE {RAW8.format('t')} GROUP BY 1""",
    "cand_logprob": f"WITH {BIGRAMS} SELECT seq_id, step, cand, round(lp, 6) AS logprob FROM ({softmax('cands')})",
    "cand_temp": f"""WITH {BIGRAMS}, t AS (SELECT seq_id, step, cand, logit / 0.7::DOUBLE AS logit FROM cands)
        SELECT seq_id, step, cand, round(lp, 6) AS logprob FROM ({softmax('t')})""",
    "cand_topk": f"""WITH {BIGRAMS} SELECT seq_id, step, cand FROM (SELECT *,
        rank() OVER (PARTITION BY seq_id, step ORDER BY logit DESC) AS r FROM cands) WHERE r <= 5""",
    "cand_topp": f"""WITH {BIGRAMS},
        k AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY seq_id, step ORDER BY logit DESC) AS r FROM cands)
          WHERE r <= 20),
        p AS ({softmax('k')}),
        b AS (SELECT *, coalesce(sum(exp(lp)) OVER (PARTITION BY seq_id, step ORDER BY logit DESC, cand
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
        SELECT seq_id, step, cand FROM b WHERE before <= 0.7531""",
    "cand_greedy": f"""WITH {BIGRAMS} SELECT seq_id, step, cand AS picked FROM (SELECT *,
        row_number() OVER (PARTITION BY seq_id, step ORDER BY logit DESC, cand) AS r FROM cands) WHERE r = 1""",
    "cand_sample": f"""WITH {BIGRAMS},
        u AS (SELECT *, (('0x' || substr(md5('42|' || seq_id || '|' || step || '|' || cand), 1, 8))::BIGINT + 1)
          / (4294967296.0::DOUBLE + 1) AS u FROM cands)
        SELECT seq_id, step, cand AS picked FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, step
          ORDER BY logit - ln(-ln(u)) DESC, cand) AS r FROM u) WHERE r = 1""",
    "cand_mask_audit": f"""WITH {LEX8}, {BIGRAMS}, {BLOCKED}, s AS ({softmax('marked')})
        SELECT seq_id, step, count(*) AS n_cands, count(*) FILTER (blocked) AS n_blocked,
          round(coalesce(sum(exp(lp)) FILTER (blocked), 0), 9) AS removed_mass,
          first(cand ORDER BY logit DESC, cand) AS greedy_before,
          first(cand ORDER BY logit DESC, cand) FILTER (NOT blocked) AS greedy_after FROM s GROUP BY 1, 2""",
    "cand_masked_pick": f"""WITH {LEX8}, {BIGRAMS}, {BLOCKED}, s AS ({softmax('marked')})
        SELECT seq_id, step, cand AS picked, round(lp, 6) AS logprob FROM (SELECT *, row_number() OVER
          (PARTITION BY seq_id, step ORDER BY blocked, logit DESC, cand) AS r FROM s) WHERE r = 1""",
    "cand_soft_penalty": f"""WITH {BIGRAMS},
        raw AS (SELECT seq_id, step, cand, logit + CASE WHEN is_eos THEN 0 ELSE """
    + " + ".join(f"CASE WHEN contains({JOINED}, '{t}') THEN -1.5 ELSE 0 END" for t in V.LEXICON8)
    + " + "
    + " + ".join(f"CASE WHEN regexp_matches({JOINED}, '{p.regex}') THEN {C.NEG_INF_CONST} ELSE 0 END" for p in P.PII)
    + f""" + CASE WHEN contains({JOINED}, '!') THEN -0.25 ELSE 0 END END AS s FROM cands)
        SELECT seq_id, step, cand, CASE WHEN s >= -1000000 THEN round(s, 6) END AS score FROM raw""",
    "violated_constraints": f"""WITH {DOCS}, {LEX8},
        v AS (SELECT doc_id, -1.5::DOUBLE AS penalty FROM docs JOIN lex ON contains(text, term)
          """
    + " ".join(
        f"UNION ALL SELECT doc_id, -10.0::DOUBLE FROM docs WHERE regexp_matches(text, '{p.regex}')" for p in P.PII
    )
    + """)
        SELECT doc_id, count(*) AS n_violated, sum(penalty) AS penalty FROM v GROUP BY 1""",
    "nbest_clean": f"""WITH {LEX8} SELECT prompt_id, gen_id, rank FROM (SELECT doc_id % 100 AS prompt_id, doc_id AS gen_id,
          row_number() OVER (PARTITION BY doc_id % 100 ORDER BY -n_chars / 10.0 DESC, doc_id) AS rank
          FROM documents WHERE NOT regexp_matches(text, '{ALL}') AND NOT {RAW8.format('text')}) WHERE rank <= 3""",
    "seq_perplexity": f"""WITH {BIGRAMS}, s AS ({softmax('cands')})
        SELECT doc_id, count(*) AS n_tokens, round(sum(lp), 4) AS score, round(exp(-avg(lp)), 4) AS perplexity
        FROM pairs JOIN s USING (seq_id, cand) WHERE NOT is_eos GROUP BY 1""",
    "cand_state_mask": f"""WITH {LEX8}, {STATES}, {BIGRAMS},
        ctxs AS (SELECT seq_id FROM ctx WHERE NOT regexp_matches(seq_id, '{"|".join(V.LEXICON8)}')),
        tails AS (SELECT seq_id, unnest(generate_series(0, length(seq_id))) AS n FROM ctxs),
        best AS (SELECT seq_id, max(n) AS n FROM tails WHERE right(seq_id, n) IN (SELECT state FROM st) GROUP BY 1)
        SELECT seq_id, cand, right(seq_id, n) AS state,
          NOT is_eos AND regexp_matches(seq_id || cand, '{"|".join(V.LEXICON8)}') AS blocked
        FROM cands JOIN best USING (seq_id)""",
    "sql_functions": f"""SELECT doc_id, lower(source) AS name, substr(text, 31) AS answer,
          CASE WHEN doc_id % 2 = 0 THEN 'rtp_toxic_vocab' ELSE 'unsupported' END AS mode, {reason('text')} AS reason,
          {first_end('text')} AS end_first, regexp_replace(text, '{ALL}', '[PII]', 'g') AS redacted FROM documents""",
    "stream_filter": f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{ALL}')",
    "stream_scan": f"""WITH {DOCS} SELECT doc_id AS seq_id, {first_end('text')} AS end_first FROM docs
        WHERE regexp_matches(text, '{ALL}')""",
}
SQL["token_scan_terms_grams"] = SQL["token_scan_terms"]
SQL["token_scan_regex"] = f"WITH {DOCS}, g AS (SELECT doc_id AS seq_id, substr(text, 22) AS t FROM docs) " + " UNION ALL ".join(
    f"SELECT seq_id, '{p.name}' AS pattern, 3 + ({end_of('t', lazy)} - 1) // 7 AS pos FROM g WHERE regexp_matches(t, '{lazy}')"
    for p, lazy in zip(P.PII, LAZY)
)

SQL["violation_report_grams"] = SQL["violation_report"]
SQL["cand_penalty_join"] = SQL["cand_soft_penalty"]
SQL["generations_roundtrip"] = f"WITH {DOCS}, {GENERATIONS} SELECT idx, prompt, output FROM gens"
SQL["lexicon_roundtrip"] = f"""WITH {DOCS},
    spans AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{ALL}')) AS span FROM docs)
    SELECT 'union' AS reader, span AS term FROM spans UNION ALL SELECT 'evaluation', lower(span) FROM spans"""
SQL["report_roundtrip"] = f"""WITH {DOCS}, {LEX8}, {GENERATIONS}, {ANSWERS}, {REPORT}
    SELECT file, method, seed, mode, total_examples, violations, CASE WHEN total_examples > 0 AND mode <> 'unsupported'
      THEN round(violations / total_examples * 100, 6) END AS violation_rate, NULL AS error FROM report
    UNION ALL SELECT DISTINCT file, NULL, NULL, NULL, NULL, NULL, NULL, 'Too few parts: ' || file FROM gens
    WHERE file = 'broken_name.jsonl'"""
SQL["setting_throughput"] = f"""WITH {DOCS}, {LEX8}, {GENERATIONS}, {ANSWERS}, {REPORT},
    log AS (SELECT file, len(string_split(output, ' ')) AS t, length(output) / 100 AS s FROM gens),
    pooled AS (SELECT method, dataset, model_alias, batch_size, sum(t)::BIGINT AS new_tokens, sum(s) AS seconds
      FROM report JOIN log USING (file) GROUP BY ALL),
    rated AS (SELECT *, CASE WHEN seconds > 0 THEN new_tokens / seconds END AS r FROM pooled)
    SELECT a.method, a.dataset, a.model_alias, a.batch_size, a.new_tokens, round(a.seconds, 3) AS seconds,
      round(a.r, 6) AS tokens_per_second, round(a.r / b.r, 6) AS relative
    FROM rated a LEFT JOIN (SELECT * FROM rated WHERE method = 'base') b USING (dataset, model_alias, batch_size)"""
SQL["constraint_modes"] = f"""WITH {DOCS}, {LEX8}
    SELECT doc_id, 'ENFORCE:' || term AS constraint_id FROM docs JOIN lex ON contains(text, term)
    UNION ALL SELECT doc_id, 'SELECT:' || term FROM docs JOIN lex ON contains(lower(text), ' ' || lower(term) || ' ')
    UNION ALL SELECT doc_id, 'EVAL:' || term FROM docs JOIN lex ON contains(text, ' ' || lower(trim(term)) || ' ')"""
SQL["stream_filter_terms"] = SQL["toxic_raw"]
SQL["stream_scan_gaps"] = f"""WITH {DOCS},
    s AS (SELECT doc_id AS seq_id, text, doc_id % 7 = 0 AND length(text) > {(V.LOST_CHUNK + 1) * V.CHUNK_CHARS} AS lossy,
      substr(text, 1, {V.LOST_CHUNK * V.CHUNK_CHARS}) AS a, substr(text, {(V.LOST_CHUNK + 1) * V.CHUNK_CHARS + 1}) AS b FROM docs),
    e AS (SELECT seq_id, lossy, {first_end('text')} AS e, {first_end('a')} AS ea, {first_end('b')} AS eb FROM s),
    f AS (SELECT seq_id, CASE WHEN lossy THEN coalesce(ea, {V.LOST_CHUNK * V.CHUNK_CHARS} + eb) ELSE e END AS end_first FROM e)
    SELECT seq_id, 'match' AS kind, end_first, NULL::INT AS gap_from, NULL::INT AS gap_to FROM f WHERE end_first IS NOT NULL
    UNION ALL SELECT seq_id, 'gap', NULL, {V.LOST_CHUNK}, {V.LOST_CHUNK} FROM e WHERE lossy AND ea IS NULL"""
SQL["stream_scan_terms"] = f"""WITH {LEX8} SELECT doc_id AS seq_id, min(strpos(text, term) - 1 + length(term)) AS end_first
    FROM documents JOIN lex ON contains(text, term) GROUP BY doc_id"""
SQL["constraint_regex_index"] = f"""WITH {VOCAB}, c AS (SELECT piece, piece || '[,.]? [a-z]*(?:ed|ing)' AS re FROM vocab
      WHERE regexp_full_match(piece, '[a-z]{{10,}}')),
    g AS (SELECT DISTINCT doc_id, substr(text, i, 10) AS g
      FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 9)) AS i FROM documents)),
    near AS (SELECT doc_id, piece, re FROM g JOIN c ON g = left(piece, 10))
    SELECT doc_id, piece AS constraint_id FROM near JOIN documents USING (doc_id) WHERE regexp_matches(text, re)"""
SQL["redact_all"] = f"""WITH {DOCS}, {LEX8}, p AS ({SQL['pii_spans']}),
    i AS (SELECT doc_id, text, term, unnest(generate_series(1, length(text))) AS i FROM docs JOIN lex ON contains(text, term)),
    t AS (SELECT doc_id, i - 1 AS s, i - 1 + length(term) AS e FROM i WHERE substr(text, i, length(term)) = term),
    u AS (SELECT doc_id, start AS s, "end" AS e FROM p UNION ALL SELECT * FROM t),
    r AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
    h AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS n FROM r),
    g AS (SELECT doc_id, n, min(s) AS s, max(e) AS e FROM h GROUP BY ALL),
    l AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS last FROM g),
    c AS (SELECT doc_id, string_agg(substr(text, (last + 1)::BIGINT, (s - last)::BIGINT) || '[X]', '' ORDER BY s) || substr(any_value(text), (max(e) + 1)::BIGINT) AS made
      FROM l JOIN docs USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, coalesce(made, text) AS redacted FROM docs LEFT JOIN c USING (doc_id)"""
SQL["lexicon_roundtrip_large"] = f"WITH {VOCAB} SELECT piece AS term FROM vocab"
SQL["results_roundtrip"] = f"""WITH {DOCS}, {LEX8}, {GENERATIONS}, {ANSWERS}, {REPORT},
    r AS (SELECT method, dataset, model_alias, batch_size, seed, idx, length(output) AS n,
        method = 'ours' AND dataset = 'RTP' AND file IN (SELECT file FROM gens WHERE length(output) > 300) AS again
      FROM gens JOIN report USING (file))
    SELECT method, dataset, model_alias, batch_size, seed, idx, CASE WHEN again THEN -n ELSE n END AS n_chars
    FROM r WHERE NOT again OR n > 300"""
SQL["list_files_roundtrip"] = f"""WITH {DOCS}, {GENERATIONS}
    SELECT file, 1 AS n_files, 2 AS length FROM (SELECT DISTINCT file FROM gens)
    UNION ALL SELECT 'ours_Enron_phi_4_16_42.jsonl', 1, 0"""
SQL["run_rollup"] = f"""WITH {DOCS}, {LEX8}, {GENERATIONS}, {ANSWERS}, {REPORT}
    SELECT dataset, model_alias, method, bit_count(grouping_id(dataset, model_alias, method)) AS level, count(*) AS n_files,
      sum(total_examples)::BIGINT AS total_examples, sum(violations)::BIGINT AS violations,
      round(CASE WHEN sum(total_examples) > 0 THEN sum(violations) / sum(total_examples) * 100 END, 6) AS violation_rate
    FROM report WHERE mode <> 'unsupported' GROUP BY ROLLUP (dataset, model_alias, method)"""
SQL["batch_index_text"] = """SELECT source, hash, min(i) AS first_idx, max(i) AS last_idx, min(i) // 16 AS first_batch, count(*) AS n
    FROM (SELECT source, md5(text) AS hash, row_number() OVER (ORDER BY source NULLS FIRST, md5(text) NULLS FIRST) - 1 AS i FROM documents) GROUP BY ALL"""
