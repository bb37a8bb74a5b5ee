"""Interestingness measures of a rule X => y as expressions over its 2x2 contingency counts.

A rule has columns fx, fy, fz (rows that hold X, y, both) and n (all rows).  ``smooth`` is added to each of the four
cells.  Where a denominator vanishes the measure is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _null0(c: Column) -> Column:
    return F.when(c != 0, c)


@dataclass(frozen=True)
class Table:
    """The cells and margins of the contingency table as doubles."""

    n: Column
    n11: Column
    n10: Column
    n01: Column
    n00: Column
    n1x: Column
    nx1: Column
    n0x: Column
    nx0: Column


def contingency(fx: Column | str = "fx", fy: Column | str = "fy", fz: Column | str = "fz", n: Column | str = "n", smooth: float = 0.0) -> Table:
    x, y, z, all_ = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (fx, fy, fz, n))
    s = float(smooth)
    return Table(n=all_ + 4 * s, n11=z + s, n10=x - z + s, n01=y - z + s, n00=all_ - x - y + z + s, n1x=x + 2 * s, nx1=y + 2 * s, n0x=all_ - x + 2 * s, nx0=all_ - y + 2 * s)


def confidence(t: Table) -> Column:
    return t.n11 / _null0(t.n1x)


def lift(t: Table) -> Column:
    return t.n * t.n11 / _null0(t.n1x * t.nx1)


def cosine(t: Table) -> Column:
    return t.n11 / _null0(F.sqrt(t.n1x * t.nx1))


def phi(t: Table) -> Column:
    return (t.n * t.n11 - t.n1x * t.nx1) / _null0(F.sqrt(t.n1x * t.nx1 * t.n0x * t.nx0))


def kruskal(t: Table) -> Column:
    most = F.greatest(t.nx1, t.nx0)
    return (F.greatest(t.n11, t.n10) + F.greatest(t.n01, t.n00) - most) / _null0(t.n - most)


def odds_ratio(t: Table) -> Column:
    return t.n11 * t.n00 / _null0(t.n10 * t.n01)


def yule_q(t: Table) -> Column:
    odds = odds_ratio(t)
    return (odds - 1) / _null0(odds + 1)


def pavillon(t: Table) -> Column:
    return t.n11 / _null0(t.n1x) - t.nx1 / _null0(t.n)


def certainty(t: Table) -> Column:
    one = (t.n11 / _null0(t.n1x) - t.nx1 / _null0(t.n)) / _null0(1 - t.nx1 / _null0(t.n))
    other = (t.n11 / _null0(t.nx1) - t.n1x / _null0(t.n)) / _null0(1 - t.n1x / _null0(t.n))
    return F.when(one.isNotNull() & other.isNotNull(), F.greatest(one, other))


def support(t: Table) -> Column:
    return t.n11 / _null0(t.n)


def revsup(t: Table) -> Column:
    return 1 - support(t)


MEASURES = {"confidence": confidence, "lift": lift, "cosine": cosine, "phi": phi, "kruskal": kruskal, "yuleQ": yule_q, "pavillon": pavillon, "certainty": certainty, "support": support, "revsup": revsup}
RANGES = {"confidence": (0, 1), "lift": (0, float("inf")), "cosine": (0, 1), "phi": (-1, 1), "kruskal": (0, 1), "yuleQ": (-1, 1), "pavillon": (-0.5, 1), "certainty": (-1, 1), "support": (0, 1), "revsup": (0, 1)}


def measure(name: str, table: Table) -> Column:
    if name not in MEASURES:
        raise ValueError(f"unknown measure {name!r}; known: {', '.join(MEASURES)}")
    return MEASURES[name](table)


def in_range(name: str, value: Column | str, tolerance: float = 1.0) -> Column:
    """Whether a value lies in the measure's range, widened by ``tolerance``; null counts as inside."""
    low, high = RANGES[name]
    c = F.col(value) if isinstance(value, str) else value
    inside = (c >= low - tolerance) & (F.lit(True) if high == float("inf") else c <= high + tolerance)
    return F.coalesce(inside, F.lit(True))


def vector(names: list[str], smooth: float = 0.0, x: str = "x", y: str = "y") -> Column:
    """The measures of a rule in order; all 0 if its antecedent or its consequent is empty."""
    t = contingency(smooth=smooth)
    bare = (F.coalesce(F.length(x), F.lit(0)) == 0) | (F.coalesce(F.length(y), F.lit(0)) == 0)
    return F.array(*(F.when(bare, 0.0).otherwise(measure(name, t)) for name in names))
