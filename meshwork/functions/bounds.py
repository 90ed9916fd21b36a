"""Column expressions of structural similarity. All in double precision, left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: added to squared counts before they are compared with a bound.
TOLERANCE = 1e-8


def bound(du: Column, dv: Column, eps: float) -> Column:
    """What a squared closed common count must reach for an edge between degrees du and dv."""
    e = F.lit(float(eps))
    return e * e * (du.cast("double") + F.lit(1.0)) * (dv.cast("double") + F.lit(1.0))


def reaches(common: Column, limit: Column) -> Column:
    c = common.cast("double")
    return c * c + F.lit(TOLERANCE) >= limit


def verdict(du: Column, dv: Column, eps: float) -> Column:
    """What degrees alone decide: 'out', 'in', or 'open' (the common neighbours must be counted)."""
    b = bound(du, dv, eps)
    return F.when(~reaches(du + 2, b) | ~reaches(dv + 2, b), F.lit("out")).when(reaches(F.lit(2), b), F.lit("in")).otherwise(F.lit("open"))


def open_cosine(common: Column, du: Column, dv: Column) -> Column:
    """Squared cosine of open neighbourhoods."""
    return F.lit(1.0) * common * common / (du.cast("double") * dv.cast("double"))


def partition_of(v: Column, offsets: list[int]) -> Column:
    """The least p with v < offsets[p + 1]; null beyond the last."""
    out = F.lit(None).cast("int")
    for p in range(len(offsets) - 2, -1, -1):
        out = F.when(v < F.lit(offsets[p + 1]), F.lit(p)).otherwise(out)
    return out


def handles(own: Column, other: Column, parts: int) -> Column:
    """Whether partition `own` handles the edges between it and `other`: the next half of the ring,
    and of opposite partitions (an even number of them) the lower one."""
    step = F.pmod(other - own, F.lit(parts))
    near = (step >= 1) & (step * 2 < parts)
    return near | ((step * 2 == parts) & (own * 2 < parts)) if parts % 2 == 0 else near


def ring_owner(p: Column, q: Column, parts: int) -> Column:
    """Which of two different partitions handles the edges between them."""
    return F.when(handles(p, q, parts), p).otherwise(q)
