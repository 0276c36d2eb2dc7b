"""Probability vectors as array<double> columns: softmax, divergences, entropies, distances, masks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def _zip_sum(a: Column, b: Column, term) -> Column:
    return _sum(F.zip_with(a, b, term))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: an expression used within a lambda would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    """log of the softmax of logits / temperature, against the maximum for stability."""
    scaled = F.transform(logits, lambda x: x.cast("double") / temperature)
    norm = lambda s, top: F.log(_sum(F.transform(s, lambda x: F.exp(x - top)))) + top
    return let(scaled, lambda s: let(F.array_max(s), lambda top: let(norm(s, top), lambda n: F.transform(s, lambda x: x - n))))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    return F.transform(log_softmax(logits, temperature), F.exp)


def entropy(p: Column) -> Column:
    """In nats; terms of 0 count as 0."""
    return -_sum(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))


def kl(p: Column, q: Column) -> Column:
    """Sum of p (log p - log q), with q clamped away from 0."""
    return _zip_sum(p, q, lambda x, y: F.when(x > 0, x * (F.log(x) - F.log(F.greatest(y, F.lit(TINY))))).otherwise(0.0))


def jsd(p: Column, q: Column, alpha: float = 0.5) -> Column:
    """alpha KL(q | m) + (1 - alpha) KL(p | m) with m = (1 - alpha) p + alpha q; KL(q | p) for 0 and KL(p | q) for 1."""
    if alpha == 0:
        return kl(q, p)
    if alpha == 1:
        return kl(p, q)
    m = mixture(p, q, alpha)
    return alpha * kl(q, m) + (1 - alpha) * kl(p, m)


def mixture(p: Column, q: Column, weight: float | Column) -> Column:
    return F.zip_with(p, q, lambda x, y: (1 - weight) * x + weight * y)


def total_variation(p: Column, q: Column) -> Column:
    return 0.5 * _zip_sum(p, q, lambda x, y: F.abs(x - y))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    dot = _zip_sum(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    size = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.try_divide(dot, size(a) * size(b))


def rms(a: Column) -> Column:
    return F.sqrt(F.try_divide(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))), F.size(a)))


def projection(a: Column, b: Column) -> Column:
    """(a . b) / (a . a), 0 for a vanishing a."""
    own = _zip_sum(a, a, lambda x, y: x * y)
    return F.when(own <= 1e-20, 0.0).otherwise(F.try_divide(_zip_sum(a, b, lambda x, y: x * y), own))


def orthogonal_part(a: Column, b: Column, size: float = 1.0) -> Column:
    """What a leaves of b at a right angle, scaled to an RMS of `size`."""
    rest = let(projection(a, b), lambda share: F.zip_with(a, b, lambda x, y: y - x * share))
    return let(rest, lambda r: let(rms(r), lambda norm: F.transform(r, lambda x: F.coalesce(F.try_divide(x * size, norm), F.lit(0.0)))))


def k3(log_ratio: Column) -> Column:
    """exp(r) - r - 1 of r = log reference - log policy: an unbiased, non-negative estimate of KL."""
    return F.exp(log_ratio) - log_ratio - 1


def importance_ratio(old: Column, sampling: Column, cap: float) -> Column:
    return F.least(F.exp(old - sampling), F.lit(float(cap)))


def forward_gradient(p: Column, q: Column) -> Column:
    """By the logits of p, of KL(q | p): p - q."""
    return F.zip_with(p, q, lambda x, y: x - y)


def reverse_gradient(p: Column, q: Column) -> Column:
    """By the logits of p, of KL(p | q): p (r - sum p r) with r = log p - log q."""
    gap = F.zip_with(p, q, lambda x, y: F.log(F.greatest(x, F.lit(TINY))) - F.log(F.greatest(y, F.lit(TINY))))
    return let(_zip_sum(p, gap, lambda x, r: x * r), lambda mean: F.zip_with(p, gap, lambda x, r: x * (r - mean)))


def ema(values: Column, alpha: float, start: Column) -> Column:
    """The moving reference after an ordered array: ref = alpha * value + (1 - alpha) * ref."""
    return F.aggregate(values, start.cast("double"), lambda ref, x: alpha * x + (1 - alpha) * ref)


def top_share(weights: Column, share: float) -> Column:
    """Part of the total that the largest ceil(share * n) weights hold."""
    ordered = F.reverse(F.array_sort(weights))
    return F.try_divide(_sum(F.slice(ordered, 1, F.ceil(F.size(weights) * F.lit(share)).cast("int"))), _sum(weights))


def reliability(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), from 0 to 1."""
    gap = (a - b) / (a + b + 1e-12)
    return F.least(F.greatest(gap, F.lit(0.0)), F.lit(1.0))


def calibrate(score, target: float | Column, rounds: int = 60) -> Column:
    """The c in [0, 1] where an increasing score(c) reaches the target, by halving; 1 if it never does."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halved(s, goal):
        mid = (s["lo"] + s["hi"]) / 2
        return let(score(mid) < goal, lambda low: F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi")))

    def found(goal):
        at = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: halved(s, goal), lambda s: (s["lo"] + s["hi"]) / 2)
        return F.when(score(F.lit(1.0)) < goal, 1.0).otherwise(at)

    return let(target if isinstance(target, Column) else F.lit(float(target)), found)


def normal_two_sided(z: Column) -> Column:
    """The two-sided p-value of a normal z, by a series of the error function: neither Spark nor Arrow has erf."""
    x = F.abs(z) / math.sqrt(2)
    # erf(x) = 2/sqrt(pi) * exp(-x^2) * sum of x (2 x^2)^n / (1 * 3 * 5 ... (2n + 1)): all terms positive.
    def step(s, n):
        term = s["term"] * 2 * x * x / (2 * n + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(150)), F.struct(x.alias("term"), x.alias("sum")), step, lambda s: s["sum"])
    erf = 2 / math.sqrt(math.pi) * F.exp(-x * x) * total
    return F.when(x > 7, 0.0).otherwise(F.greatest(1 - erf, F.lit(0.0)))
