"""Column expressions on weight slots, bounds and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SLOTS, WEIGHTS


def slot_array() -> Column:
    return F.array(*[F.col(w) for w in WEIGHTS])


def min_weight() -> Column:
    """The least weight of an edge; null if all slots are null."""
    return F.least(*[F.col(w) for w in WEIGHTS])


def min_slot() -> Column:
    """The lowest slot that holds the least weight; 8 if all slots are null."""
    return F.coalesce(F.array_position(slot_array(), min_weight()).cast("int") - 1, F.lit(SLOTS))


def edge_name(src: str = "src", dst: str = "dst") -> Column:
    return F.concat(F.col(src), F.lit("->"), F.col(dst))


def label() -> Column:
    """An edge's first weight that is not null, as text; n/a if there is none."""
    return F.coalesce(F.coalesce(*[F.col(w) for w in WEIGHTS]).cast("string"), F.lit("n/a"))


def in_bounds(value: Column, low, high) -> Column:
    """low < value <= high."""
    return (value > low) & (value <= high)


def scaled(factor_tenths: int, weight: str) -> Column:
    """weight x factor / 10, half away from zero; null stays null."""
    x = F.col(weight) * factor_tenths
    return (F.signum(x).cast("long") * F.floor((F.abs(x) + 5) / 10).cast("long")).cast("long")


def bucket_index(value: Column, bounds: list[float]) -> Column:
    """The bucket of [-inf, b0), [b0, b1), ..., [b_last, inf)."""
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(value < bounds[i], i).otherwise(out)
    return out


def equal_bounds(low: float, high: float, buckets: int) -> list[float]:
    """buckets - 1 bounds at equal distances."""
    if buckets < 1:
        raise ValueError("at least one bucket is needed")
    return [low + (high - low) / buckets * (i + 1) for i in range(buckets - 1)]


def find_base(n: int, span: float) -> float:
    """The least of 1.01, 1.02, ... whose n-th power exceeds ``span``."""
    step = 101
    while (step / 100) ** n <= span:
        step += 1
    return step / 100


def geometric_bounds(low: float, high: float, buckets: int) -> list[float]:
    """buckets - 1 bounds at distances from ``low`` that grow by a fixed factor."""
    if buckets < 1:
        raise ValueError("at least one bucket is needed")
    base = find_base(buckets, high - low)
    return [low + base ** (i + 1) for i in range(buckets - 1)]
