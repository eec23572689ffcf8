"""Fixed-length arrays of steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def left_pad(steps: Column, length: int | Column, pad: Column) -> Column:
    """Copies of `pad` in front until there are `length` steps."""
    wanted = F.lit(length) if isinstance(length, int) else length
    missing = F.greatest(wanted.cast("int") - F.size(steps), F.lit(0))
    return F.concat(F.array_repeat(pad, missing), steps)


def keep_last(steps: Column, count: int) -> Column:
    return F.slice(steps, F.greatest(F.size(steps) - (count - 1), F.lit(1)), count)


def drop_padding(steps: Column, pad: float) -> Column:
    """Steps none of whose entries is the pad value."""
    return F.filter(steps, lambda step: ~F.array_contains(step, F.lit(pad).cast("float")))


def repeat_label(label: Column, length: int) -> Column:
    return F.array_repeat(label, length)
