"""Columns for evaluation: pass@k, schedules, decision rules, logit filters."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n-c, k) / C(n, k), 1 where fewer than k samples fail, null where n < k or anything is null."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda p, i: p * (1 - k / i))
    return F.when(n < k, F.lit(None).cast("double")).when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1 - product)


def learning_rate(step: Column, peak: float, floor: float, warm: int, total: int) -> Column:
    """Linear warm-up, then a cosine down to ``floor``, then ``floor``."""
    way = (step - warm) / F.lit(float(max(1, total - warm)))
    return F.when(step < warm, peak * (step + 1) / F.lit(float(warm))).when(step >= total, F.lit(floor)).otherwise(floor + 0.5 * (peak - floor) * (1 + F.cos(F.lit(pi) * way)))


# Limits of the decision rules.
CONFIRM, REJECT, RATIO = 0.3, 0.5, 1.10
GAINS = (0.05, 0.015, 0.008)
LONG_SHARE, DOMAIN_MARGIN = 0.25, 1.10
TOPIC_TOLERANCE, LEAST_GAIN, SPEED_GATE = 0.05, 0.05, 1.3


def hypothesis(p_end: Column, ratio: Column) -> Column:
    return F.when((p_end < CONFIRM) & (ratio >= RATIO), "confirmed").when(p_end >= REJECT, "rejected").when(p_end.isNotNull() & ratio.isNotNull(), "mixed")


def domain_rating(loss: Column, mix: Column) -> Column:
    return F.when(loss > DOMAIN_MARGIN * mix, "weak").when(loss.isNotNull() & mix.isNotNull(), "ok")


def abort_reasons(step: Column, ratio: Column, stop: Column, abort_step: int, most_ratio: float = 0.85, least_stop: float = 0.5) -> Column:
    """Reasons to end a run, joined by "; "; null before ``abort_step``, where none holds, and if that is not positive."""
    if abort_step <= 0:
        return F.lit(None).cast("string")
    said = F.concat_ws("; ", F.when(ratio > most_ratio, "ratio"), F.when(stop < least_stop, "stop"))
    return F.when((step >= abort_step) & (said != ""), said)


def objective(strict: Column, repetitive: Column) -> Column:
    return (strict + 1 - repetitive) / 2


def penalised(logits: Column, recent: Column, penalty: float) -> Column:
    """Logits of recent ids divided by the penalty if positive, multiplied if not."""
    return F.transform(logits, lambda v, i: F.when(F.array_contains(recent, i), F.when(v > 0, v / penalty).otherwise(v * penalty)).otherwise(v))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, not again for each element of an array."""
    return F.get(F.transform(F.array(value), use), 0)


def top_k(logits: Column, k: int) -> Column:
    """Logits below the k-th greatest become null; ties with it stay."""
    some = F.array_compact(logits)
    least = F.get(F.sort_array(some, asc=False), F.least(F.lit(k), F.size(some)) - 1)
    return _let(least, lambda t: F.transform(logits, lambda v: F.when(v >= t, v)))


def softmax(logits: Column) -> Column:
    """Probabilities; nulls stay out and stay null."""
    parts = _let(F.array_max(logits), lambda most: F.transform(logits, lambda v: F.exp(v - most)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return _let(parts, lambda xs: _let(total(xs), lambda t: F.transform(xs, lambda v: v / t)))


def min_p(logits: Column, share: float) -> Column:
    """Logits whose probability is less than ``share`` of the greatest one become null."""
    return _let(F.array_max(logits), lambda most: F.transform(logits, lambda v: F.when(F.exp(v - most) >= share, v)))


def top_p(logits: Column, share: float) -> Column:
    """Logits after those whose probabilities, from the greatest down, reach ``share`` become null; the one that crosses it
    stays, and so do ties with it."""
    ordered = F.sort_array(softmax(logits), asc=False)
    step = lambda s, p: F.struct((s["sum"] + F.coalesce(p, F.lit(0.0))).alias("sum"), F.when(s["sum"] < share, p).otherwise(s["least"]).alias("least"))
    least = F.aggregate(ordered, F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("least")), step, lambda s: s["least"])
    return _let(F.struct(softmax(logits).alias("p"), least.alias("t")), lambda x: F.zip_with(logits, x["p"], lambda v, p: F.when(p >= x["t"], v)))


def filtered(logits: Column, k: int, share: float, least: float) -> Column:
    """The chain of filters: min-p, then top-k, then top-p; 0 for k or ``least``, or a share of 1, leaves a filter out."""
    out = min_p(logits, least) if least > 0 else logits
    out = top_k(out, k) if k > 0 else out
    return top_p(out, share) if share < 1 else out


def drawn(logits: Column, chance: Column) -> Column:
    """The place, from 0, at which the running probability of the logits first exceeds ``chance``; nulls are never drawn."""
    step = lambda s, p: F.struct((s["sum"] + F.coalesce(p, F.lit(0.0))).alias("sum"), (s["i"] + 1).alias("i"), F.when(s["hit"].isNull() & p.isNotNull() & (s["sum"] + p > chance), s["i"]).otherwise(s["hit"]).alias("hit"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("hit"))
    return F.aggregate(softmax(logits), start, step, lambda s: s["hit"])


def banned_by_ngram(history: Column, n: int) -> Column:
    """Ids that would repeat an n-gram of the history, in order of their first place."""
    size = F.size(history)
    last = F.slice(history, F.greatest(size - (n - 2), F.lit(1)), n - 1)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda i: F.slice(history, i, n - 1) == last)
    return F.array_distinct(F.transform(hits, lambda i: F.element_at(history, i + (n - 1))))
