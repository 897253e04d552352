"""Column expressions shared by the learners and metrics (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LOSSES = ("exp", "log")


def _check_loss(loss: str) -> None:
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}, got {loss!r}")


def tidy(col: Column, digits: int = 6) -> Column:
    """Round for reporting; never returns -0.0."""
    return F.round(col, digits) + F.lit(0.0)


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def logistic_loss(label: Column, score: Column) -> Column:
    """ln(1 + e^(-y s)) for labels -1/+1, without overflow."""
    margin = label * score
    return F.log1p(F.exp(-F.abs(margin))) + F.greatest(-margin, F.lit(0.0))


def cross_entropy(label: Column, prob: Column, eps: float = 1e-15) -> Column:
    """-(y ln p + (1-y) ln(1-p)) for labels 0/1, probabilities clipped to [eps, 1-eps]."""
    p = F.least(F.greatest(prob, F.lit(eps)), F.lit(1.0 - eps))
    return -(label * F.log(p) + (F.lit(1.0) - label) * F.log(F.lit(1.0) - p))


def multiplier(label: Column, score: Column, loss: str) -> Column:
    """d loss / d raw score: -y/(1+e^(y s)) in "exp" mode, p - y in "log" mode."""
    _check_loss(loss)
    if loss == "exp":
        return -label / (F.lit(1.0) + F.exp(label * score))
    return sigmoid(score) - label


def pointwise_loss(label: Column, score: Column, loss: str) -> Column:
    """Loss of a raw score under either label convention."""
    _check_loss(loss)
    if loss == "exp":
        return logistic_loss(label, score)
    return logistic_loss(F.lit(2.0) * label - F.lit(1.0), score)


def soft_threshold(value: Column, threshold) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.signum(value) * F.greatest(F.lit(0.0), F.abs(value) - t) + F.lit(0.0)


def step_size(alpha: float, t: Column) -> Column:
    return F.lit(float(alpha)) / F.sqrt(t)


def time_decay(elapsed: Column, tau: float) -> Column:
    return F.exp(-elapsed / F.lit(2.0 * tau * tau))


def log_odds(prob: Column) -> Column:
    return F.log(prob / (F.lit(1.0) - prob))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays of one length."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def split_tokens(col: Column, sep: str = " ") -> Column:
    """Trimmed split without empty tokens."""
    return F.filter(F.split(F.trim(col), sep), lambda t: t != "")


def parse_number(col: Column, dtype: str = "double") -> Column:
    """Number or null, never an error."""
    return col.try_cast(dtype)


def safe_divide(a: Column, b: Column) -> Column:
    """Quotient or null when the divisor is zero."""
    return F.try_divide(a, b)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))
