"""The scalar functions as SQL functions of a session, inlined into the query by the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.runs import NO_MODE, REGEX_MARK, REGEX_MODE, TERM_MARK, TERM_MODE
from . import patterns as P
from .text import END_MARKERS, WS, quote


def _raw(pattern: str) -> str:
    """A raw SQL string literal."""
    return f'r"{pattern}"'


def _trim_left(value: str) -> str:
    pattern = _raw(rf"(?U)\A{WS}+")
    return f"regexp_replace({value}, {pattern}, '')"


def _trim_right(value: str) -> str:
    pattern = _raw(rf"(?U)(?<!{WS}){WS}+\z")
    return f"regexp_replace({value}, {pattern}, '')"


def _without_markers(value: str) -> str:
    for marker in END_MARKERS:
        pattern = _raw(rf"(?U)\A(?:{WS}*{quote(marker)}{WS}*)+")
        value = f"regexp_replace({value}, {pattern}, '')"
    return value


def _completion_end(value: str, pattern: P.Pattern) -> str:
    found = f"nullif(regexp_extract({value}, {_raw(pattern.completing)}, 0), '')"
    return f"instr({value}, {found}) - 1 + length({found})"


def definitions() -> dict[str, str]:
    """Signature and body of every function."""
    cleaned = _without_markers("answer")
    trimmed, short = _trim_left(cleaned), _trim_right("prompt")
    name = f"translate(lower({_trim_right(_trim_left('value'))}), '-.', '__')"
    reasons = " ".join(f"WHEN value RLIKE {_raw(p.completing)} THEN {_raw('match:' + p.regex)}" for p in P.PII)
    ends = ", ".join(_completion_end("value", p) for p in P.PII)
    return {
        "norm_name(value STRING) RETURNS STRING": name,
        "strip_prompt(prompt STRING, answer STRING) RETURNS STRING": f"""CASE
            WHEN prompt = '' OR answer = '' THEN answer
            WHEN startswith(answer, prompt) THEN substring(answer, length(prompt) + 1)
            WHEN startswith({trimmed}, {short}) THEN substring({trimmed}, length({short}) + 1)
            ELSE {cleaned} END""",
        "path_mode(value STRING) RETURNS STRING": f"""CASE
            WHEN contains({name}, '{REGEX_MARK}') THEN '{REGEX_MODE}'
            WHEN contains({name}, '{TERM_MARK}') THEN '{TERM_MODE}' ELSE '{NO_MODE}' END""",
        "pii_reason(value STRING) RETURNS STRING": f"CASE {reasons} ELSE 'ok' END",
        "pii_completion_end(value STRING) RETURNS INT": f"least({ends})",
        "pii_redact(value STRING, placeholder STRING) RETURNS STRING": (
            f"CASE WHEN value RLIKE {_raw(P.probe())} THEN regexp_replace(value, {_raw(P.scan())}, placeholder) ELSE value END"
        ),
    }


def register(spark: SparkSession) -> None:
    for signature, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
