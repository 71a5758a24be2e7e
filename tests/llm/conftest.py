"""A table with the awkward rows that every operator has to take."""

import pytest
from pyspark.sql import Row

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    state, out = seed * 7919 + 13, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 8) % len(WORDS)] + str((state >> 16) % 97))
    return " ".join(out)


PASSAGE = prose(999, 60)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `row` string"


def documents() -> list[tuple]:
    texts = [prose(i, 40 + i) for i in range(12)]
    texts += [texts[0]] * 3  # exact copies
    texts += [texts[1] + " end", texts[1].upper()]  # near copies
    texts += [prose(40 + i, 30) + " " + PASSAGE + " " + prose(60 + i, 30) for i in range(4)]  # a shared passage
    texts += ["", None, " \t\n", "word", "ÄÖ ü é " * 40, "x" * 5000, prose(5, 9000)]
    texts += [PASSAGE + "\n" + PASSAGE]  # within one text
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else "src0", len(t) if t else None, None, "r") for i, t in enumerate(texts)]
    rows.append((None, prose(77, 50), None, None, None, 1.0, None))
    rows += [(3, texts[3], "en", "src0", None, None, "r")] * 2  # repeated rows
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [Row(doc_id=i, quality=int(i % 2), toxic=0) for i in range(20)]
    return spark.createDataFrame(rows)
