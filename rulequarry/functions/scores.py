"""Score functions: from the measures of a rule to one number."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import measures

Mobius = dict[tuple[int, ...], float]


def _columns(values: Sequence[Column | str]) -> list[Column]:
    return [F.col(v) if isinstance(v, str) else v for v in values]


def linear(values: Sequence[Column | str], weights: Sequence[float] | None = None) -> Column:
    """Weighted sum; without weights each counts 1."""
    columns = _columns(values)
    weights = [1.0] * len(columns) if weights is None else list(weights)
    if len(weights) != len(columns):
        raise ValueError("as many weights as values are needed")
    total = F.lit(0.0)
    for c, w in zip(columns, weights):
        total = total + c * float(w)
    return total


def owa(values: Sequence[Column | str], weights: Sequence[float], ordered: bool = False) -> Column:
    """Ordered weighted average; ``ordered`` sorts the values upwards first, else they are taken as they come."""
    if not ordered:
        return linear(values, weights)
    line = F.array_sort(F.array(*_columns(values)))
    return linear([line[i] for i in range(len(weights))], weights)


def lexmin_weights(n: int, delta: float) -> list[float]:
    """Weights that let earlier positions dominate: d^i / (1 + d)^(i + 1), and what is left for the last."""
    return [delta**i / (1 + delta) ** (i + 1) for i in range(n - 1)] + [delta ** (n - 1) / (1 + delta) ** (n - 1)]


def phi_score(smooth: float = 1e-6) -> Column:
    """The chi-squared score of a rule: phi with smoothed counts."""
    return measures.phi(measures.contingency(smooth=smooth))


def choquet(values: Sequence[Column | str], capacity: dict[int, float]) -> Column:
    """Choquet integral from a capacity by bit mask of criteria (bit i stands for value i)."""
    columns = _columns(values)
    n = len(columns)
    full = (1 << n) - 1
    if full not in capacity:
        raise ValueError("the capacity of the full set is missing")
    lookup = F.create_map(*(x for mask, m in sorted(capacity.items()) for x in (F.lit(mask), F.lit(float(m)))))
    line = F.array_sort(F.array(*(F.struct(c.alias("v"), F.lit(i).alias("i")) for i, c in enumerate(columns))))
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("last"), F.lit(full).alias("mask"))

    def step(s: Column, e: Column) -> Column:
        gain = (e["v"] - s["last"]) * F.coalesce(F.try_element_at(lookup, s["mask"]), F.lit(0.0))
        return F.struct((s["sum"] + gain).alias("sum"), e["v"].alias("last"), s["mask"].bitwiseAND(F.bitwise_not(F.element_at(_powers(n), e["i"] + 1))).alias("mask"))

    return F.aggregate(line, state, step, lambda s: s["sum"])


def _powers(n: int) -> Column:
    return F.array(*(F.lit(1 << i) for i in range(n)))


def choquet_mobius(values: Sequence[Column | str], masses: Mobius) -> Column:
    """Choquet integral from Moebius masses: the sum over subsets of mass times least value."""
    columns = _columns(values)
    total = F.lit(0.0)
    for subset, m in sorted(masses.items(), key=lambda e: (len(e[0]), e[0])):
        if subset:
            low = columns[subset[0]] if len(subset) == 1 else F.least(*(columns[i] for i in subset))
            total = total + low * float(m)
    return total


def equal_capacity(n: int) -> dict[int, float]:
    """The same weight for every proper subset, 1 for the full set."""
    full = (1 << n) - 1
    return {m: (0.0 if m == 0 else 1.0 if m == full else 1 / (2**n - 2)) for m in range(full + 1)}


def capacity_of(masses: Mobius, n: int) -> dict[int, float]:
    """The capacity whose Moebius transform is ``masses``."""
    bits = {sum(1 << i for i in subset): m for subset, m in masses.items()}
    return {mask: sum(m for b, m in bits.items() if b & mask == b) for mask in range(1 << n)}


def mobius_of(capacity: dict[int, float], n: int) -> Mobius:
    out: Mobius = {}
    for mask in range(1 << n):
        total, sub = 0.0, mask
        while True:
            total += (-1) ** bin(mask ^ sub).count("1") * capacity.get(sub, 0.0)
            if not sub:
                break
            sub = (sub - 1) & mask
        out[tuple(i for i in range(n) if mask >> i & 1)] = total
    return out


def shapley(masses: Mobius, n: int) -> list[float]:
    """Shapley value of each criterion: its share of the mass of every subset that holds it."""
    return [sum(m / len(s) for s, m in masses.items() if i in s) for i in range(n)]


def interaction(masses: Mobius, n: int) -> list[list[float]]:
    """Pairwise interaction indices; 0 on the diagonal."""
    return [[0.0 if i == j else sum(m / (len(s) - 1) for s, m in masses.items() if i in s and j in s) for j in range(n)] for i in range(n)]


def normalized_linear(values: Sequence[Column | str], most: Sequence[Column | str], weights: Sequence[float]) -> Column:
    """Weighted sum of values over their greatest amounts."""
    return linear([v / m for v, m in zip(_columns(values), _columns(most))], weights)


def valid_score(score: Column, valid: Column) -> Column:
    """The score of a valid rule, 0 of another."""
    return F.when(valid, score).otherwise(0.0)


def share_of_class(fy: str = "fy", n: str = "n") -> Column:
    """The weight that the unrestricted sampler climbs: (fx / n) * (fy / fx) = fy / n."""
    return F.col(fy).cast("double") / F.col(n)


def get_score_function(kind: str, **parameters) -> Callable[[Sequence[Column | str]], Column]:
    """A score function by name; unknown names raise."""
    if kind == "linear":
        return lambda values: linear(values, parameters.get("weights"))
    if kind == "owa":
        return lambda values: owa(values, parameters["weights"], parameters.get("ordered", False))
    if kind == "lexmin":
        return lambda values: owa(values, lexmin_weights(len(values), parameters.get("delta", 0.01)), parameters.get("ordered", False))
    if kind == "choquet":
        return lambda values: choquet(values, parameters["capacity"])
    if kind == "mobiusChoquet":
        return lambda values: choquet_mobius(values, parameters["masses"])
    raise ValueError(f"unknown score function {kind!r}")
