"""Histogram edges: how many bins, and where round numbers put them."""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits on the number of bins and the steps that count as round.
AUTO_BINS = (5, 30)
REQUESTED_BINS = (2, 100)
ROUND_STEPS = (1, 2, 2.5, 5, 10)


def clamp(value: int, bounds: tuple[int, int]) -> int:
    return int(min(max(value, bounds[0]), bounds[1]))


def automatic_bins(n: int, low: float, high: float, q1: float, q3: float) -> int:
    """Bin count from the spread of the middle half, bounded by two rules on the sample size."""
    span = high - low
    by_spread = 2.0 * (q3 - q1) * n ** (-1.0 / 3.0)
    by_root = span / math.sqrt(n)
    by_log = span / (math.log2(n) + 1.0)
    width = min(max(by_spread, by_root / 2), by_log)
    return clamp(math.ceil(span / width) if width else 1, AUTO_BINS)


def round_step(least: float) -> float:
    """The smallest round number that is not below ``least``."""
    power = 10 ** math.floor(math.log10(least))
    choices = [multiple * power for multiple in ROUND_STEPS]
    return choices[min(bisect_left(choices, least), len(choices) - 1)]


def round_edges(low: float, high: float, target: int) -> list[float]:
    """Neighbouring multiples of a round step, from the last one up to ``low`` to the first one from ``high`` on."""
    if low == high:
        return [low - 0.5, high + 0.5]
    step = round_step((high - low) / target)
    multiples = range(math.floor(low / step), max(math.ceil(high / step), math.floor(low / step) + 1) + 1)
    return [round(k * step, 10) for k in multiples]


#: Significant digits of a label, and of one that is close to 0.
LABEL_DIGITS, SMALL_LABEL_DIGITS = 6, 3


def edge_label(edge: Column) -> Column:
    """A number for people: whole ones with thousands separators, others by their first digits, very large and very small
    ones of those with a power of ten."""
    size = F.abs(edge)
    plain = lambda value: F.call_function("format_number", value, F.lit("#,##0.##########"))
    powered = lambda digits: F.regexp_replace(F.format_string(f"%.{digits - 1}e", edge), r"\.?0*e", "e")
    unit = F.pow(F.lit(10.0), F.floor(F.log10(size)) - (LABEL_DIGITS - 1))
    return (
        F.when(edge == F.rint(edge), plain(edge))
        .when(size < 1e-4, powered(SMALL_LABEL_DIGITS))
        .when(size >= 10**LABEL_DIGITS, powered(LABEL_DIGITS))
        .otherwise(plain(F.rint(edge / unit) * unit))
    )
