"""Seeded hashing: every random decision is a function of a text key.

A draw never depends on partitioning, task order or retries, so a lost executor
recomputes the same rows, and plain SQL can repeat it. The hash keeps 60 bits, so
``hash % n`` stays unbiased for tables of many billions of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60
_HEX_DIGITS = HASH_BITS // 4


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def hash60(*parts) -> Column:
    """Non-negative 60-bit integer hash of the parts joined by ``|`` (nulls skipped)."""
    digest = F.md5(F.concat_ws("|", *[_text(p) for p in parts]))
    return F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Number in ``[0, 1)`` drawn by the key ``parts``."""
    return hash60(*parts).cast("double") / F.lit(float(1 << HASH_BITS))
