"""Bins that are open on the left and closed on the right."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """Number of the bin (low, high] that holds `value`, from 0; null outside all bins."""
    index = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        index = F.when((value > low) & (value <= high), i).otherwise(index)
    return index


def bin_label(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    index = bin_index(value, edges)
    return F.get(F.array(*[F.lit(label) for label in labels]), index)
