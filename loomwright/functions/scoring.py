"""Workload scores as column arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright import vocab as V


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def level(score: Column, low: float | Column, high: float | Column) -> Column:
    return F.when(score < low, "low").when(score < high, "medium").otherwise("high")


def level_for(score: Column, kind: str) -> Column:
    return level(score, *V.LEVEL_CUTS[kind])


def eeg_level(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")


def personal_cuts(baseline: Column) -> tuple[Column, Column]:
    """Level cut points of a user: derived from the baseline score, else the common ones."""
    low, high = V.LEVEL_CUTS["fusion"]
    return (
        F.when(baseline.isNull(), low).otherwise(F.greatest(F.lit(0.1), baseline * 0.7)),
        F.when(baseline.isNull(), high).otherwise(F.least(F.lit(0.9), baseline * 1.3)),
    )


def _metric(x: Column, low: float, high: float, strict: bool) -> Column:
    if high <= low and not strict:
        return F.lit(0.5)
    return clamp((x - low) / (high - low))


def behaviour_score(
    back_rate: Column, error_rate: Column, click_density: Column, duration_ms: Column, completion_rate: Column,
    weights: dict[str, float] | None = None, strict_completion: bool = False,
) -> Column:
    """Weighted metrics between their thresholds.

    The completion thresholds run downwards, so that metric is the constant 0.5 unless ``strict_completion`` is set.
    """
    weights = weights or V.BEHAVIOUR_WEIGHTS
    values = {
        "back_rate": back_rate, "error_rate": error_rate, "click_density": click_density,
        "duration_sec": duration_ms / 1000, "completion_rate": completion_rate,
    }
    parts = [
        _metric(values[m], *V.BEHAVIOUR_THRESHOLDS[m], strict_completion) * F.lit(float(weights[m])) for m in values
    ]
    return F.round(clamp(reduce(lambda a, b: a + b, parts)), 4)


def tlx_unit(answer: Column) -> Column:
    """Answer 1..7 to 0..1."""
    return (answer - 1) / 6.0


def tlx_score(units: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the six dimensions, performance turned round; 0.5 when the weights sum to zero."""
    weights = {d: float((weights or {}).get(d, 1.0)) for d in V.TLX_DIMENSIONS}
    total = sum(weights.values())
    if total == 0:
        return F.lit(0.5)
    turned = {d: (1.0 - units[d] if d == "performance" else units[d]) for d in V.TLX_DIMENSIONS}
    return reduce(lambda a, b: a + b, [turned[d] * weights[d] for d in V.TLX_DIMENSIONS]) / total


def fused_score(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Mean of the present modality scores with their weights scaled up; 0.5 when nothing carries weight."""
    weights = weights or V.MODALITY_WEIGHTS
    top = reduce(lambda a, b: a + b, [F.coalesce(s * weights[m], F.lit(0.0)) for m, s in scores.items()])
    base = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), weights[m]).otherwise(0.0) for m, s in scores.items()])
    return F.when(base == 0, 0.5).otherwise(top / base)


def fusion_method(scores: dict[str, Column]) -> Column:
    present = reduce(lambda a, b: a | b, [s.isNotNull() for s in scores.values()])
    return F.when(present, "weighted").otherwise("default")


def adjusted_weights(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """MAP of the weights in force: scaled over the present modalities, or all of them when those weigh nothing."""
    weights = weights or V.MODALITY_WEIGHTS
    base = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), weights[m]).otherwise(0.0) for m, s in scores.items()])
    every = F.create_map(*[x for m in scores for x in (F.lit(m), F.lit(float(weights[m])))])
    present = F.map_filter(
        F.create_map(*[x for m, s in scores.items() for x in (F.lit(m), F.when(s.isNotNull(), weights[m]) / base)]),
        lambda _, w: w.isNotNull(),
    )
    return F.when(base == 0, every).otherwise(present)


def _ratio(x: Column, default: float) -> Column:
    return F.when(x.isNull() | (x == 0), default).otherwise(x)


def eeg_score(theta_beta: Column, alpha_beta: Column, theta_alpha: Column, any_power: Column, clamp_all: bool = False) -> Column:
    """Score from the three ratios; a missing or zero ratio takes its default, no valid power gives 0.5."""
    tb, ab, ta = _ratio(theta_beta, 1.5), _ratio(alpha_beta, 1.5), _ratio(theta_alpha, 1.0)
    ta_part = F.least(ta / 2.5, F.lit(1.0)) if clamp_all else ta / 2.5
    raw = 0.5 * F.least(tb / 3.0, F.lit(1.0)) + 0.3 * (1.0 - clamp(ab / 2.5)) + 0.2 * ta_part
    return F.when(any_power, clamp(raw)).otherwise(F.lit(0.5))


def eeg_score_with_baseline(theta_ratio: Column, alpha_ratio: Column, tbr_change: Column) -> Column:
    zero = F.lit(0.0)
    load = (
        0.4 * F.greatest(zero, theta_ratio - 1.0)
        + 0.3 * F.greatest(zero, 1.0 - alpha_ratio)
        + 0.3 * F.greatest(zero, tbr_change - 1.0)
    )
    return 1.0 / (1.0 + F.exp(-3.0 * (load - 0.5)))
