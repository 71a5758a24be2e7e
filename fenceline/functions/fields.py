"""Text fields of schema-less JSON records, held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys tried in order after the configured one.
ANSWER_KEYS = ("output", "answer", "completion", "continuation")
PROMPT_KEYS = ("prompt", "input", "instruction", "query")


def _path(*keys: str) -> str:
    return "$" + "".join(f'["{k}"]' for k in keys)


def text_field(record: Column, key: str) -> Column:
    """A string, or the string under ``text`` of an object, else ""."""

    def string_at(*keys: str) -> Column:
        path = _path(*keys)
        kind = F.schema_of_variant(F.try_variant_get(record, path, "variant"))
        return F.when(kind == "STRING", F.try_variant_get(record, path, "string"))

    return F.coalesce(string_at(key), string_at(key, "text"), F.lit(""))


def first_text(record: Column, keys) -> Column:
    """The first non-empty text among ``keys``, else ""."""
    return F.coalesce(*[F.nullif(text_field(record, k), F.lit("")) for k in keys], F.lit(""))


def _ordered(key: str, defaults) -> list[str]:
    return [key] + [k for k in defaults if k != key]


def answer_text(record: Column, key: str = "output") -> Column:
    return first_text(record, _ordered(key, ANSWER_KEYS))


def prompt_text(record: Column, key: str = "prompt") -> Column:
    return first_text(record, _ordered(key, PROMPT_KEYS))
