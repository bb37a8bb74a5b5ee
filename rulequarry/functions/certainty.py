"""How certain it is that one of two scored rules is better, and how uncertain a pair is."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 0.001


def score_difference(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    """Affine in the difference of two scores in [0, 1]; not clamped outside."""
    return (1 - epsilon) * ((a - b) / 2 + 0.5) + epsilon


def bradley_terry(a: Column, b: Column) -> Column:
    """Logistic in the difference of the scores, without overflow for great ones."""
    return 1 / (1 + F.exp(b - a))


def normal_cdf(x: Column) -> Column:
    """Distribution function of the normal law (Abramowitz and Stegun 26.2.17, error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * (0.319381530 * t - 0.356563782 * t * t + 1.781477937 * t * t * t - 1.821255978 * t * t * t * t + 1.330274429 * t * t * t * t * t)
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def thurstone(a: Column, b: Column) -> Column:
    return normal_cdf(a - b)


def steep_logistic(a: Column, b: Column, slope: float = 10.0) -> Column:
    """Logistic with a slope, as drawn for search spaces."""
    return 1 / (1 + F.exp(slope * (b - a)))


CERTAINTIES: dict[str, Callable[[Column, Column], Column]] = {"ScoreDifference": score_difference, "BradleyTerry": bradley_terry, "Thurstone": thurstone}


def certainty(name: str) -> Callable[[Column, Column], Column]:
    if name not in CERTAINTIES:
        raise ValueError(f"unknown certainty {name!r}")
    return CERTAINTIES[name]


def uncertainty(theta: Column) -> Column:
    """1 where neither is better, 0 where it is certain which."""
    return 1 - F.abs(1 - 2 * theta)


def exponential_noise(theta: Column, beta: float) -> Column:
    """Chance of a wrong answer to a comparison of certainty ``theta``."""
    return 0.5 * F.exp(-beta * theta)


def adaptive_threshold(t: Column, horizon: float) -> Column:
    """The certainty to ask for at step t of ``horizon``: from 1/2 down, constant behind the horizon."""
    return 0.5 * F.exp(-4 * F.least(t, F.lit(float(horizon))) / horizon)
