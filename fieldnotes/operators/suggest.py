"""What to look at first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .columns import BOOLEAN, CATEGORICAL, EMPTY, NUMERIC, Profile

# Fixed value: a first comparison has at most this many groups if it can.
FEW_LEVELS = 20


@dataclass
class Suggestion:
    variable: str | None
    group_by: str | None
    metric: str | None
    agg: str | None
    table: DataFrame


def _first(profiles: list[Profile], *tests) -> Profile | None:
    """The first column in table order that passes the first test any column passes."""
    for test in tests:
        for p in profiles:
            if test(p):
                return p
    return None


def suggest(ds) -> Suggestion:
    """A first variable and a first comparison for a table nobody has looked at yet."""
    profiles = ds.profiles()

    def continuous(p: Profile) -> bool:
        return p.kind == NUMERIC and not p.is_identifier and not p.discrete

    def offered_as_group(p: Profile) -> bool:
        return not p.is_identifier and (p.kind in (CATEGORICAL, BOOLEAN) or (p.kind == NUMERIC and p.discrete))

    variable = _first(
        profiles, continuous, lambda p: not p.is_identifier and p.kind != EMPTY, lambda p: True
    )
    group = _first(
        profiles,
        lambda p: p.kind == CATEGORICAL and not p.is_identifier and p.unique <= FEW_LEVELS,
        offered_as_group,
    )
    metric = _first(profiles, lambda p: continuous(p) and p is not group) if group else None
    names = [p.name if p else None for p in (variable, group, metric)]
    agg = ("mean" if metric else "count") if group else None
    table = ds.spark.createDataFrame([(*names, agg)], "variable string, group_by string, metric string, agg string")
    return Suggestion(*names, agg, table)
