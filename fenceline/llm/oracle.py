"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .licenses import OTHER, TEMPLATES, THRESHOLD, bigrams_of
from .mixing import DIGITS, POWER, SEED

_TEMPLATES = ", ".join(f"('{name}', {bigrams_of(t)!r})" for name, t in TEMPLATES.items())
_SPACE = r"[\x20\x09-\x0D]+"

SQL = {
    "op1_poisson_mixing": f"""
with sized as (select doc_id, source, text, coalesce(strlen(text), 0) + 1 as size from documents),
sources as (select source, sum(size)::double as size from sized group by source),
rated as (
  select source, pow(size, {POWER}) / (select sum(pow(size, {POWER})) from sources)
    * (select sum(size) from sources) / size as rate
  from sources),
steps as (
  select source, rate, k, case when k = 0 then -rate
    else -rate + k * ln(rate) - sum(case when k > 0 then ln(k) else 0 end) over (partition by source order by k) end as log
  from (select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::bigint + 1)) as k from rated)),
cumulated as (select source, sum(exp(log)) over (partition by source order by k) as p from steps),
drawn as (
  select doc_id, source, size,
    (('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(doc_id::varchar, 'null'), coalesce(source, 'null'),
      md5(coalesce(text, '')))), 1, {DIGITS}))::bigint + 0.5) / {float(16**DIGITS)!r} as u
  from sized),
counted as (
  select d.doc_id, d.source, d.size, d.u, count(p)::int as n
  from drawn d join cumulated c on d.source is not distinct from c.source and c.p <= d.u
  group by all)
select doc_id, source, n as count, copy::int as copy, size,
  md5(concat_ws('|', '{SEED}', coalesce(doc_id::varchar, 'null'), coalesce(source, 'null'), copy::varchar)) as order_key
from (select *, unnest(range(0, n)) as copy from counted)
""",
    "op6_rule_ledger": f"""
with own as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
split as (
  select r, doc_id, text, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from own),
windows as (
  select r, i, array_to_string(words[i : i + 7], ' ') as w
  from (select r, words, unnest(range(1, len(words) - 6)) as i from split)),
again as (
  select r, i from (select r, i, count(*) over (partition by r, w) as n from windows) where n > 1),
covered as (
  select r, sum(least(8, coalesce(nxt - i, 8))) as n
  from (select r, i, lead(i) over (partition by r order by i) as nxt from again) group by r),
measured as (
  select s.r, doc_id, len(words)::bigint as n_words,
    coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
    len(lines)::bigint as n_lines
  from split s left join covered c on s.r = c.r),
failed as (
  select *, ((n_words < 20)::bigint + 2 * (100 * n_repeat_words > 30 * n_words)::bigint
    + 4 * (10 * n_symbols > n_words)::bigint + 8 * (100 * n_dup_lines > 30 * n_lines)::bigint
    + 16 * (word_chars < 2 * n_words)::bigint + 32 * (word_chars > 20 * n_words)::bigint)::bigint as failed
  from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failed,
  failed & 3 <> 0 as base_failed, failed = 0 as kept, 'v2' as policy
from failed
""",
    "op8_license_bigrams": f"""
with templates(license, bigrams) as (values {_TEMPLATES}),
own as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
lines as (select r, string_split(text, chr(10)) as parts, text from own),
units as (
  select r, unnest(u) as u, unnest(range(len(u))) as unit
  from (select r, case when len(parts) > 1 then list_concat([text], parts) else [text] end as u from lines)),
words as (select r, unit, string_split(trim(regexp_replace(lower(u), '{OTHER}', ' ', 'g')), ' ') as w from units),
pairs as (
  select r, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b
  from words where len(w) > 1),
matched as (
  select r, unit, license, 2.0::double * len(list_intersect(b, bigrams)) / (len(b) + len(bigrams)) as score
  from pairs, templates
  where len(b) >= len(bigrams) * {THRESHOLD} / (2 - {THRESHOLD}) and len(b) <= len(bigrams) * (2 - {THRESHOLD}) / {THRESHOLD}),
hits as (select * from matched where score >= {THRESHOLD}),
best as (
  select r, first(license order by score desc, license, unit) as license, max(score) as score,
    first(unit order by score desc, license, unit)::int as unit, count(*) as n_matches,
    string_agg(distinct license, ',' order by license) as licenses
  from hits group by r)
select doc_id, license, score, unit, coalesce(n_matches, 0)::bigint as n_matches, coalesce(licenses, '') as licenses
from own left join best using (r)
""",
}
