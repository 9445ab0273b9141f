"""Column functions for severity, priority, quality and cost."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline import vocab


def chosen(key: Column, values: Mapping, other: object) -> Column:
    """The value of a small fixed table, or another."""
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.element_at(table, key), F.lit(other))


def signal(x: Column, denom: float = 1.0) -> Column:
    """A raw signal on a scale up to 1; missing is 0."""
    return F.round(F.least(F.coalesce(x, F.lit(0.0)) / denom, F.lit(1.0)), 4)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once however often f names it, wherever the plan puts it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def weighted_signals(cls: Column, depth: Column, area: Column, contrast: Column, sharpness: Column) -> Column:
    """The sum that raw_score() rounds."""
    signals = (signal(depth), signal(area, vocab.SIGNAL_DENOMS["area"]), signal(contrast, vocab.SIGNAL_DENOMS["contrast"]), signal(sharpness, vocab.SIGNAL_DENOMS["sharpness"]))
    out = F.lit(0.0)
    for i, s in enumerate(signals):
        out = out + chosen(cls, {c: w[i] for c, w in vocab.SIGNAL_WEIGHTS.items()}, 0.25) * s
    return out


def raw_score(cls: Column, depth: Column, area: Column, contrast: Column, sharpness: Column) -> Column:
    return F.round(weighted_signals(cls, depth, area, contrast, sharpness), 4)


def severity_score(raw: Column, cls: Column) -> Column:
    return F.round(F.least(raw * chosen(cls, vocab.CLASS_WEIGHTS, 0.25) * 2.0, F.lit(1.0)), 4)


def level(score: Column) -> Column:
    def of(s: Column) -> Column:
        out = F.lit("S1")
        for floor, name, _ in reversed(vocab.LEVELS):
            out = F.when(s >= floor, name).otherwise(out)
        return out

    return once(score, of)


def action(name: Column) -> Column:
    return chosen(name, {n: a for _, n, a in vocab.LEVELS}, "Emergency closure")


def priority_v1(severity: Column, count: Column) -> Column:
    return F.round(chosen(severity, vocab.PRIORITY_WEIGHTS, 0.25) * F.ln(count + 1), 6)


def priority_v2(severity: Column, count: Column) -> Column:
    return F.round(F.coalesce(severity, F.lit(1)) * F.ln(F.coalesce(count, F.lit(1)) + 1), 4)


def repair_cost(cls: Column, severity: Column) -> Column:
    """Price of one repair; halves round up."""
    return F.floor(chosen(cls, vocab.REPAIR_COST, vocab.OTHER_COST) * chosen(severity, vocab.COST_FACTOR, 1.0) + 0.5).cast("long")


def banded(score: Column, bands: tuple[tuple[str, int], ...], last: str = "E") -> Column:
    out = F.lit(last)
    for name, floor in reversed(bands):
        out = F.when(score >= floor, name).otherwise(out)
    return out
