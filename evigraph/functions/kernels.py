"""Bayes-factor kernels as Column expressions.

All of them stay inside code generation.  ``x`` is a measurement, ``t`` its
reference threshold; missing values are null, and NaN or infinities count as
missing everywhere, so that they never reach a sort or an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEUTRAL = 0.5
LOGIT_CLIP = 1e-15
EXP_CLIP = 700.0


def finite(x: Column) -> Column:
    """The value, or null if it is missing, NaN or infinite."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def saturation(x: Column, t: Column) -> Column:
    """1 - exp(-(x/t)^2 / 2)."""
    return F.lit(1.0) - F.exp(F.lit(-0.5) * F.pow(x / t, F.lit(2.0)))


def floored_factor(x: Column, t: Column, floor: float = 0.5) -> Column:
    """Saturation with a floor; a missing x gets the floor, a bad threshold for a present x is an error."""
    x, t = finite(x), finite(t)
    bad = F.raise_error(F.lit("finite values need positive finite thresholds")).cast("double")
    return F.when(x.isNull(), F.lit(floor)).when(t.isNull() | (t <= 0), bad).otherwise(F.greatest(F.lit(floor), saturation(x, t)))


def floored_likelihood(x: Column, t: Column, floor: float = NEUTRAL, clamp: bool = True) -> Column:
    """As above for likelihoods: negative x count as 0 (``clamp``) and anything invalid is neutral."""
    x, t = finite(x), finite(t)
    base = F.greatest(x, F.lit(0.0)) if clamp else x
    return F.when(x.isNull() | t.isNull() | (t <= 0), F.lit(floor)).otherwise(F.greatest(F.lit(floor), saturation(base, t)))


def continuous_factor(x: Column, t: Column, least: float = 1e-6, neutral: float = NEUTRAL) -> Column:
    """Factor below 1 for weak evidence: saturation over the neutral likelihood, at least ``least``."""
    x, t = finite(x), finite(t)
    return F.when(x.isNull() | t.isNull() | (t <= 0), F.lit(least)).otherwise(
        F.greatest(F.lit(least), saturation(F.greatest(x, F.lit(0.0)), t) / F.lit(neutral))
    )


def pair_likelihood(x: Column, t: Column, continuous: bool = False, least: float = 1e-6) -> Column:
    """Likelihood of a pair's value; invalid values are neutral in both modes."""
    x, t = finite(x), finite(t)
    raw = saturation(F.greatest(x, F.lit(0.0)), t)
    return F.when(x.isNull() | t.isNull() | (t <= 0), F.lit(NEUTRAL)).otherwise(F.greatest(F.lit(NEUTRAL * least if continuous else NEUTRAL), raw))


def odds_factor(score: Column, reference: float, floor: bool = False, clip: float = 1e-12) -> Column:
    """Odds of the score over the odds of the reference; ``floor`` keeps it at 1 or more."""
    if not 0 < reference < 1:
        raise ValueError("the reference must lie in (0, 1)")
    s = F.least(F.greatest(score, F.lit(clip)), F.lit(1.0 - clip))
    factor = (s / (F.lit(1.0) - s)) / F.lit(reference / (1.0 - reference))
    return F.greatest(factor, F.lit(1.0)) if floor else factor


def zero_anchored_factor(effort: Column, multiplier: float = 1.0, t: float = 6.0) -> Column:
    """1 at zero effort, towards 2 for much."""
    return (F.lit(0.5) + F.lit(0.5) * saturation(effort, F.lit(t * multiplier))) / F.lit(0.5)


def structural_factor(score: Column, reference: float, low: float, high: float) -> Column:
    if not (0 < reference < 1 and 0 < low <= 1 <= high):
        raise ValueError("bad reference or bounds")
    return F.least(F.greatest(odds_factor(score, reference, clip=1e-6), F.lit(low)), F.lit(high))


def logit(p: Column, clip: float = LOGIT_CLIP) -> Column:
    p = F.least(F.greatest(p, F.lit(clip)), F.lit(1.0 - clip))
    return F.ln(p / (F.lit(1.0) - p))


def expit(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped(z)))


def clipped(z: Column) -> Column:
    return F.greatest(F.least(z, F.lit(EXP_CLIP)), F.lit(-EXP_CLIP))


def apply_factor(prior: Column, factor: Column) -> Column:
    """Posterior; a factor of 1 leaves the prior as it is, bit by bit."""
    return F.when(F.abs(factor - 1.0) <= 1e-15, prior).otherwise(expit(logit(prior) + F.ln(factor)))


def binary_update(prior: Column, factor: Column) -> Column:
    """p B / (p B + 1 - p); a missing factor is 1."""
    b = F.coalesce(factor, F.lit(1.0))
    return prior * b / (prior * b + 1.0 - prior)


def likelihood_update(prior: Column, likelihood: Column, neutral: float = NEUTRAL) -> Column:
    return prior * likelihood / (prior * likelihood + (F.lit(1.0) - prior) * F.lit(neutral))


def log_contribution(factor: Column, weight: float | Column = 1.0) -> Column:
    return (weight if isinstance(weight, Column) else F.lit(float(weight))) * F.ln(factor)


def relative_entropy_bits(posterior: Column, prior: Column) -> Column:
    """Bernoulli divergence of the posterior from the prior, in bits; 0 log 0 is 0."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a <= 0, F.lit(0.0)).otherwise(a * F.log2(a / b))

    return part(posterior, prior) + part(F.lit(1.0) - posterior, F.lit(1.0) - prior)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
