"""Scores, decisions and closed-form statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.options import Z_95

FRAUD, LEGIT, REVIEW = "fraud", "legit", "review"


def confidence(p: Column) -> Column:
    return F.greatest(p, 1 - p)


def decide(p: Column, threshold: Column | float) -> Column:
    """Review below the confidence threshold, else fraud from 0.5 up."""
    return (
        F.when(confidence(p) < threshold, REVIEW).when(p >= 0.5, FRAUD).otherwise(LEGIT)
    )


def decide_split(p: Column, flag_at: Column | float, clear_at: Column | float) -> Column:
    """Lanes with separate cuts: flag from `flag_at` up, clear up to `clear_at`."""
    return F.when(p >= flag_at, FRAUD).when(p <= clear_at, LEGIT).otherwise(REVIEW)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom in double, null when the bottom is zero."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def logit(p: Column, clip: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def wilson_bounds(successes: Column, trials: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score interval of a proportion; null without trials."""
    n = F.nullif(trials.cast("double"), F.lit(0.0))
    share = successes.cast("double") / n
    z2 = z * z
    denominator = 1 + F.lit(z2) / n
    centre = (share + F.lit(z2) / (2 * n)) / denominator
    half = (
        F.lit(z) / denominator * F.sqrt(share * (1 - share) / n + F.lit(z2) / (4 * n * n))
    )
    # greatest/least skip nulls, so an undefined interval needs its own guard
    return (
        F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - half)),
        F.when(n.isNotNull(), F.least(F.lit(1.0), centre + half)),
    )


def log_factorial(n: Column) -> Column:
    """ln n!: a running sum up to 32, Stirling's series beyond, so its cost does not grow."""
    x = n.cast("double")
    exact = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(32)), F.lit(1)).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + F.log(i.cast("double")),
    )
    series = (
        x * F.log(x)
        - x
        + 0.5 * F.log(2 * F.pi() * x)
        + 1 / (12 * x)
        - 1 / (360 * x * x * x)
        + 1 / (1260 * F.pow(x, F.lit(5.0)))
    )
    return F.when(n <= 32, exact).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def fisher_one_sided(hits_a: Column, n_a: Column, hits_b: Column, n_b: Column) -> Column:
    """P(at least `hits_a` of all hits fall into group A) under the hypergeometric law."""
    hits = hits_a + hits_b
    whole = log_choose(n_a + n_b, hits)
    # fewer than hits - n_b in group A is impossible
    low = F.greatest(hits_a, hits - n_b)
    high = F.least(hits, n_a)
    return F.aggregate(
        F.sequence(low, high),
        F.lit(0.0),
        lambda acc, i: acc + F.exp(log_choose(n_a, i) + log_choose(n_b, hits - i) - whole),
    )


def percent_text(x: Column, digits: int = 1) -> Column:
    """A percentage that prints 0% or 100% only for exactly those values, up to 4 digits."""
    out = F.format_string("%.4f%%", x * 100)
    for d in range(3, digits - 1, -1):
        text = F.format_string(f"%.{d}f%%", x * 100)
        edge = text.isin(f"{0:.{d}f}%", f"{100:.{d}f}%")
        out = F.when((x > 0) & (x < 1) & edge, out).otherwise(text)
    return out


def display_name(name: Column) -> Column:
    """Drops the first `prefix__` only."""
    return F.regexp_replace(name, "^.*?__", "")
