"""Reproducible randomness: uniforms and noise computed from row content, not from row position."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(2**48)


def hash_uniform(seed: int, purpose: str, *parts: Column, second: bool = False) -> Column:
    """A uniform in [0, 1) from seed, purpose and parts; the same on any partitioning.

    `second` is another one from the same digest, which is computed once for both.
    """
    texts = [F.coalesce(p.cast("string"), F.lit("~")) for p in parts]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *texts))
    return F.conv(F.substring(digest, 13 if second else 1, 12), 16, 10).cast("bigint") / F.lit(_SPAN)


def gaussian_days(u1: Column, u2: Column, sigma: float) -> Column:
    """Normal noise with mean 0 from two uniforms, in whole days cut toward zero."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u1))
    return (F.lit(sigma) * radius * F.cos(F.lit(2.0 * math.pi) * u2)).cast("int")
