"""Schedules and budgets as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import column


def pretrain_rate(seen: Column | str, target: int, warmup: int, peak: float) -> Column:
    """Linear warm-up, then a cosine from peak to a tenth of it."""
    s = column(seen)
    progress = (s - warmup) / float(max(1, target - warmup))
    return F.when(s < warmup, F.lit(peak) * s / float(max(1, warmup))).otherwise(peak * 0.1 + peak * 0.9 * 0.5 * (1.0 + F.cos(F.lit(math.pi) * progress)))


def tuning_rate(step: Column | str, total: int, warmup: int, peak: float) -> Column:
    """Linear warm-up, falling to a tenth of peak."""
    s = column(step)
    return F.lit(peak) * F.least(F.lit(1.0), (s + 1) / float(max(1, warmup))) * (1.0 - 0.9 * s / float(max(1, total)))


def pretrain_steps(target: int, seen: int, batch: int, accumulate: int, length: int) -> int:
    """Steps that are left of a token budget."""
    return math.ceil((target - seen) / (batch * accumulate * length))


def tuning_steps(examples: int, batch: int, accumulate: int, epochs: int, warmup_ratio: float) -> tuple[int, int]:
    """Steps of all epochs, and those of the warm-up."""
    total = math.ceil(math.ceil(examples / batch) / accumulate) * epochs
    return total, max(1, round(total * warmup_ratio))
