"""Seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seed and size of an evaluation sample.
SEED, SAMPLE_SIZE = 42, 500


def seeded_sample(df: DataFrame, key: str, n: int = SAMPLE_SIZE, seed: int = SEED) -> DataFrame:
    """At most ``n`` rows without replacement, in draw order, reproducible from seed and key."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(draw, key).limit(n)
