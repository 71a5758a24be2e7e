"""Logged next-token candidates: masking, scores and choice.

A group (seq_id, step) holds the candidates of one step, at most one row per vocabulary entry,
so its size is bounded by the vocabulary. Choices are hash aggregates, not sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import lookup_join, written

STEP = ["seq_id", "step"]
# Slices of a step that are ranked apart before they meet.
SLICES = 32
# Scores below the threshold count as minus infinity.
NEG_INF_CONST, NEG_INF_THRESH = -1000000000.0, -1000000.0
MINUS_INF = float("-inf")
# Bins of levels, for steps with more levels than bins: so many to a unit of score below the peak; all lower levels share the last one.
BINS_PER_UNIT, LAST_BIN = 64, 4096
# Candidates of one score that are ordered in one task.
SORTED = 10_000
# How far below the highest score of all a step's peak may lie for its mass to be summed relative to that score.
FAR = 600
# Characters by which texts of one level are told apart before any are sorted.
HEAD_CHARS = 3


def _step() -> Window:
    return Window.partitionBy(*STEP)


def levels(candidates: DataFrame, logit: str = "logit") -> DataFrame:
    """(seq_id, step, _level, _n): how many candidates of a step have a score, as a table: candidates are read once for it,
    and equal scores are counted before they meet."""
    counted = candidates.groupBy(*STEP, F.col(logit).alias("_level")).agg(F.count("*").alias("_n"))
    return written(counted, "levels")


def log_softmax(candidates: DataFrame, logit: str = "logit", out: str = "logprob") -> DataFrame:
    """Add the log-probability within the step; a masked candidate keeps minus infinity. A step's peak and
    mass are aggregates that are looked up: a step with very many candidates is no single task's."""
    return (
        lookup_join(candidates, step_mass(levels(candidates, logit)), STEP)
        .withColumn(out, F.col(logit) - F.col("_peak") - F.ln("_mass"))
        .drop("_peak", "_mass")
    )


def step_mass(levels: DataFrame) -> DataFrame:
    """(seq_id, step, _peak, _mass), as a table: the highest score of a step and the sum of exp(score - peak)."""
    # Sums relative to the highest score of all steps take one pass; only steps that lie so far below it that their sums would lose
    # digits are summed again, relative to their own peak.
    top = levels.agg(F.max(F.when(F.col("_level") < float("inf"), F.col("_level")))).first()[0] or 0.0
    sums = levels.groupBy(*STEP).agg(F.max("_level").alias("_peak"), F.sum(F.col("_n") * F.exp(F.col("_level") - F.lit(top))).alias("_sum"))
    sums = written(sums, "sums")
    far = (F.lit(top) - F.col("_peak") > FAR) | (F.col("_peak") == float("inf"))
    near = sums.filter(~far).select(*STEP, "_peak", (F.col("_sum") * F.exp(F.lit(top) - F.col("_peak"))).alias("_mass"))
    again = sums.filter(far).select(*STEP, "_peak")
    if again.isEmpty():
        return near
    share = F.col("_n") * F.exp(F.col("_level") - F.col("_peak"))
    own = lookup_join(levels, again, STEP).groupBy(*STEP).agg(F.first("_peak").alias("_peak"), F.sum(share).alias("_mass"))
    return written(near.unionByName(own), "mass")


def temperature(candidates: DataFrame, value: float, logit: str = "logit") -> DataFrame:
    return candidates if value == 1.0 else candidates.withColumn(logit, F.col(logit) / F.lit(float(value)))


def top_k(candidates: DataFrame, k: int, logit: str = "logit") -> DataFrame:
    """Drop candidates strictly below the k-th value; ties with it stay. ``k <= 0`` is off."""
    if k <= 0:
        return candidates
    last = written(_kth_level(levels(candidates, logit), k), "last")
    return lookup_join(candidates, last, STEP).filter(F.col(logit) >= F.col("_last")).drop("_last")


def _kth_level(levels: DataFrame, k: int) -> DataFrame:
    """(seq_id, step, _last): the k-th best score of a step, or its lowest one."""
    # Each slice of a step's levels keeps its own k best; the k-th value among them is exact.
    best = F.col("_level").desc()
    own = Window.partitionBy(*STEP, F.pmod(F.xxhash64("_level"), F.lit(SLICES))).orderBy(best)
    few = levels.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= k)
    above = F.coalesce(F.sum("_n").over(_step().orderBy(best).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return few.withColumn("_above", above).filter(F.col("_above") < k).groupBy(*STEP).agg(F.min("_level").alias("_last"))


def top_p(candidates: DataFrame, p: float, logit: str = "logit", k: int = 0) -> DataFrame:
    """Keep a candidate, in the order of score and text, while the probability before it is at most ``p``; the first
    always stays. ``p >= 1`` is off. With ``k`` the candidates are those of :func:`top_k`, found from the same levels.

    No step is sorted. The mass of a step is summed by level; a running sum over the levels (over bins of levels first, where a step has
    very many) finds the level that crosses ``p``, and how many candidates of that level stay follows from their equal
    shares. Only rows of that level are told apart, by their texts.
    """
    if p >= 1.0:
        return top_k(candidates, k, logit)
    own = levels(candidates, logit)
    if k > 0:
        last = written(_kth_level(own, k), "last")
        own = written(lookup_join(own, last, STEP).filter("_level >= _last").drop("_last"), "levels")
    cut = written(_mass_cut(own, max(0.0, float(p))), "cut")
    rows = lookup_join(candidates, cut, STEP)
    at_cut = F.col(logit) == F.col("_cut")
    extra = ["_cut", "_keep", "_n"]
    whole = rows.filter((F.col(logit) > F.col("_cut")) | (at_cut & (F.col("_keep") >= F.col("_n"))))
    kept = [whole.drop(*extra)]
    divided = cut.filter("_keep < _n")
    if not divided.filter(F.col("_n") <= SORTED).isEmpty():
        some = rows.filter(at_cut & (F.col("_keep") < F.col("_n")) & (F.col("_n") <= SORTED))
        ranked = some.withColumn("_r", F.row_number().over(_step().orderBy("cand")))
        kept.append(ranked.filter("_r <= _keep").drop("_r", *extra))
    if not divided.filter(F.col("_n") > SORTED).isEmpty():
        kept.append(_first_by_text(rows.filter(at_cut & (F.col("_keep") < F.col("_n")) & (F.col("_n") > SORTED))).drop(*extra))
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def _mass_cut(levels: DataFrame, p: float) -> DataFrame:
    """(seq_id, step, _cut, _n, _keep): the level in which the mass of a step exceeds ``p``, its candidates, and how many of
    them stay."""
    before = Window.unboundedPreceding, -1
    # Without a finite score no candidate has a share; the first one stays.
    each = F.when(F.col("_peak") == MINUS_INF, 0.0).otherwise(F.exp(F.col("_level") - F.col("_peak")) / F.col("_mass"))
    shares = lookup_join(levels, step_mass(levels), STEP).withColumn("_each", each)
    wide = levels.groupBy(*STEP).agg(F.count("*").alias("_k")).filter(F.col("_k") > LAST_BIN).select(*STEP)
    wide = written(wide, "wide")
    inside = shares.withColumn("_base", F.lit(0.0))
    if not wide.isEmpty():
        of_wide = lookup_join(shares, wide, STEP, "left_semi")
        at = F.least(F.floor((F.col("_peak") - F.col("_level")) * BINS_PER_UNIT), F.lit(LAST_BIN))
        binned = written(of_wide.withColumn("_bin", F.when(F.col("_level") == MINUS_INF, LAST_BIN).otherwise(at).cast("int")), "bins")
        # At most LAST_BIN + 1 bins to a step.
        bins = binned.groupBy(*STEP, "_bin").agg(F.sum(F.col("_n") * F.col("_each")).alias("_share"))
        base = F.coalesce(F.sum("_share").over(_step().orderBy("_bin").rowsBetween(*before)), F.lit(0.0))
        last = bins.withColumn("_base", base).filter(F.col("_base") <= p).groupBy(*STEP).agg(F.max_by(F.struct("_bin", "_base"), "_bin").alias("_b"))
        last = last.select(*STEP, F.col("_b._bin").alias("_own"), "_b._base")
        crossing = lookup_join(binned, last, STEP).filter("_bin = _own").drop("_bin", "_own")
        inside = lookup_join(inside, wide, STEP, "left_anti").unionByName(crossing)
    order = _step().orderBy(F.col("_level").desc()).rowsBetween(*before)
    inside = inside.withColumn("_before", F.col("_base") + F.coalesce(F.sum(F.col("_n") * F.col("_each")).over(order), F.lit(0.0)))
    crossing = F.min_by(F.struct("_level", "_n", "_each", "_before"), "_level").alias("_l")
    found = inside.filter(F.col("_before") <= p).groupBy(*STEP).agg(crossing).select(*STEP, "_l.*")
    keep = F.when(F.col("_level") == MINUS_INF, F.when(F.col("_before") == 0.0, 1).otherwise(0)).otherwise(
        F.least(F.floor((F.lit(p) - F.col("_before")) / F.col("_each")) + 1, F.col("_n"))
    )
    return found.select(*STEP, F.col("_level").alias("_cut"), "_n", keep.cast("bigint").alias("_keep"))


def _first_by_text(rows: DataFrame) -> DataFrame:
    """The ``_keep`` first rows of each step in the order of ``cand``. Beginnings of texts are counted and summed up in order; only rows of the
    beginning in which the count is reached are sorted."""
    rows = rows.withColumn("_head", F.left("cand", F.lit(HEAD_CHARS)))
    sizes = rows.groupBy(*STEP, "_head").agg(F.count("*").alias("_size"))
    order = _step().orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    placed = lookup_join(rows, written(sizes.withColumn("_first", F.coalesce(F.sum("_size").over(order), F.lit(0))), "heads"), [*STEP, "_head"])
    kept = placed.filter(F.col("_first") < F.col("_keep"))
    whole = kept.filter(F.col("_first") + F.col("_size") <= F.col("_keep"))
    rank = F.row_number().over(Window.partitionBy(*STEP, "_head").orderBy("cand"))
    some = kept.filter(F.col("_first") + F.col("_size") > F.col("_keep")).withColumn("_r", rank)
    some = some.filter(F.col("_first") + F.col("_r") <= F.col("_keep")).drop("_r")
    return whole.unionByName(some).drop("_head", "_size", "_first")


def greedy(candidates: DataFrame, logit: str = "logit", out: str = "picked") -> DataFrame:
    """(seq_id, step, picked): the highest score, ties broken by the candidate text."""
    best = F.min(F.struct((-F.col(logit)).alias("s"), F.col("cand").alias("c")))
    return candidates.groupBy(*STEP).agg(best.alias("_b")).select(*STEP, F.col("_b.c").alias(out))


def uniform(seed: int, *parts: str) -> Column:
    """A number strictly inside (0, 1) that depends on the seed and the parts only."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))
    return (F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") + 1) / F.lit(2.0**32 + 1)


def sample(candidates: DataFrame, seed: int, logit: str = "logit", out: str = "picked") -> DataFrame:
    """One draw per step with softmax probabilities (the highest Gumbel-perturbed score)."""
    noise = -F.ln(-F.ln(uniform(seed, "seq_id", "step", "cand")))
    return greedy(candidates.withColumn("_g", F.col(logit) + noise), "_g", out)


def soft_score(logit: Column, penalty: Column, is_eos: Column) -> Column:
    """The score plus the penalty; sums below the threshold become minus infinity. The end marker is
    never penalised."""
    raw = logit + F.when(is_eos, 0.0).otherwise(F.coalesce(penalty, F.lit(0.0)))
    return F.when(raw < NEG_INF_THRESH, F.lit(MINUS_INF)).otherwise(raw)


def penalised(candidates: DataFrame, penalties: DataFrame, logit: str = "logit", out: str = "score") -> DataFrame:
    """Add ``out``: the soft score under the summed penalties (seq_id, step, cand, penalty) of a
    candidate, one row per constraint."""
    total = penalties.groupBy(*STEP, "cand").agg(F.sum("penalty").alias("_p"))
    score = soft_score(F.col(logit), F.col("_p"), F.col("is_eos"))
    # Few candidates have a penalty: looked up, they spare the others a shuffle.
    return lookup_join(candidates, written(total, "penalties"), [*STEP, "cand"], "left").withColumn(out, score).drop("_p")


def mask(candidates: DataFrame, logit: str = "logit") -> DataFrame:
    """Blocked candidates (boolean ``blocked``) get minus infinity; the end marker never does."""
    hit = F.col("blocked") & ~F.col("is_eos")
    return candidates.withColumn(logit, F.when(hit, F.lit(MINUS_INF)).otherwise(F.col(logit)))


def mask_audit(candidates: DataFrame) -> DataFrame:
    """Per step: candidates, blocked ones, probability removed, greedy choice before and after.

    ``blocked`` says whether the candidate would complete a violation. ``after`` is NULL when every
    candidate is blocked.
    """
    hit = F.col("blocked") & ~F.col("is_eos")
    # One pass over the candidates: what a step needs is known of its levels.
    by_level = candidates.groupBy(*STEP, F.col("logit").alias("_level")).agg(
        F.count("*").alias("_n"),
        F.count_if(hit).alias("_h"),
        F.min("cand").alias("_b"),
        F.min(F.when(~hit, F.col("cand"))).alias("_a"),
    )
    by_level = written(by_level, "levels")
    peaks = by_level.groupBy(*STEP).agg(
        F.sum("_n").alias("n_cands"),
        F.sum("_h").alias("n_blocked"),
        F.max("_level").alias("_peak"),
        F.max_by("_b", "_level").alias("greedy_before"),
        F.max_by("_a", F.when(F.col("_a").isNotNull(), F.col("_level"))).alias("greedy_after"),
    )
    share = F.exp(F.col("_level") - F.col("_peak"))
    kept = ["n_cands", "n_blocked", "greedy_before", "greedy_after"]
    sums = lookup_join(by_level, written(peaks, "peaks"), STEP).groupBy(*STEP).agg(
        *[F.first(c).alias(c) for c in kept], (F.sum(F.col("_h") * share) / F.sum(F.col("_n") * share)).alias("removed_mass")
    )
    return sums.select(*STEP, "n_cands", "n_blocked", "removed_mass", "greedy_before", "greedy_after")


def chosen_logprob(candidates: DataFrame, picks: DataFrame) -> DataFrame:
    """(seq_id, step, picked, logprob) with the original, unmasked log-probability of the pick. Only the picks are scored."""
    chosen = lookup_join(candidates.withColumnRenamed("cand", "picked"), picks.select(*STEP, "picked"), [*STEP, "picked"], "left_semi")
    scored = lookup_join(chosen.select(*STEP, "picked", "logit"), step_mass(levels(candidates)), STEP)
    return scored.select(*STEP, "picked", (F.col("logit") - F.col("_peak") - F.ln("_mass")).alias("logprob"))


def sequence_scores(*chosen: DataFrame) -> DataFrame:
    """(seq_id, n_tokens, score, perplexity) from the log-probabilities of the chosen tokens; a row with a
    count ``times`` stands for so many tokens. Of several tables each is summed up and written by itself."""
    totals = [_totals(part) for part in chosen]
    if len(totals) > 1:
        every = written(totals[0], "totals")
        for part in totals[1:]:
            every = every.unionByName(written(part, "totals"))
        summed = every.groupBy("seq_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("score"))
    else:
        summed = totals[0]
    return summed.withColumn("perplexity", F.exp(-F.col("score") / F.col("n_tokens")))


def _totals(chosen: DataFrame) -> DataFrame:
    times = F.col("times") if "times" in chosen.columns else F.lit(1)
    return chosen.groupBy("seq_id").agg(
        F.sum(times).cast("bigint").alias("n_tokens"), F.sum(times * F.col("logprob")).alias("score")
    )


def best_completions(clean: DataFrame, n: int = 1, salts: int = 32) -> DataFrame:
    """The ``n`` best completions per prompt by summed log-probability (``rank`` from 1).

    A prompt may hold a large part of all rows: each salted slice keeps its own ``n`` best before
    the slices of a prompt meet.
    """
    order = [F.col("sum_logprob").desc(), F.col("gen_id")]
    slice_ = F.pmod(F.xxhash64("gen_id"), F.lit(salts))
    inner = Window.partitionBy("prompt_id", "_slice").orderBy(*order)
    outer = Window.partitionBy("prompt_id").orderBy(*order)
    kept = clean.withColumn("_slice", slice_).withColumn("_r", F.row_number().over(inner)).filter(F.col("_r") <= n)
    return (
        kept.withColumn("rank", F.row_number().over(outer)).filter(F.col("rank") <= n).drop("_slice", "_r")
    )
