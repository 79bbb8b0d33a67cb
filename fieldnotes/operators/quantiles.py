"""Exact quantiles of columns of any size.

Sorting the values of a group in one task is fast, but only done below a known
bound. Above it the value at a rank is found by narrowing: a
fixed-size sketch proposes two values close to the rank, one counting pass
settles exactly on which side of them the rank lies, and the search goes on
between them. Every pass is a scan with a small aggregate; no value is moved.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

# Values (with repeats) that one task may hold to answer a quantile directly.
DIRECT_LIMIT = 2_000_000
_GRID = 1_000
_SKETCH_ACCURACY = 10_000


@dataclass
class _Search:
    """The value with ``rank`` lies strictly between ``low`` and ``high``; None is open."""

    key: int
    group: Any
    rank: int
    ahead: int   # values at or below ``low``
    inside: int  # values strictly between the bounds
    low: Any = None
    high: Any = None
    answer: Any = None


def ranks_of(n: int, share: float) -> tuple[int, int, float]:
    """The two 0-based ranks a quantile lies between, and how far it is past the first."""
    exact = share * (n - 1)
    low = math.floor(exact)
    return low, min(low + 1, n - 1), exact - low


def exact_quantiles(df: DataFrame, value: str, counts: dict[Any, int], shares: list[float],
                    group: str | None = None, limit: int = DIRECT_LIMIT) -> dict[Any, list]:
    """Linearly interpolated quantiles per group.

    ``counts`` holds the number of non-NULL values of each wanted group (of the
    whole table under the key None when there is no group); its size must be
    bounded by the caller. Returns one list of quantiles per group.
    """
    wanted = {g: n for g, n in counts.items() if n}
    if not wanted:
        return {}
    if sum(wanted.values()) <= limit:
        return _direct(df, value, wanted, shares, group)
    needed = [
        (g, rank) for g, n in wanted.items() for rank in sorted({r for s in shares for r in ranks_of(n, s)[:2]})
    ]
    searches = [_Search(k, g, rank, 0, wanted[g]) for k, (g, rank) in enumerate(needed)]
    _solve(df, value, searches, group, limit)
    found = {(s.group, s.rank): s.answer for s in searches}
    result = {}
    for g, n in wanted.items():
        result[g] = []
        for share in shares:
            low, high, past = ranks_of(n, share)
            a, b = found[g, low], found[g, high]
            result[g].append(a + (b - a) * past)
    return result


def _direct(df: DataFrame, value: str, wanted: dict, shares: list[float], group: str | None) -> dict[Any, list]:
    """Sort the values of each group in one task; the caller has checked how many there are."""
    in_order = F.sort_array(F.collect_list(value)).alias("a")
    quantiles = F.array(*[_at_share("a", share) for share in shares])
    if group is None:
        return {None: list(df.agg(in_order).select(quantiles).first()[0])}
    kept = df.where(F.col(group).isin(*wanted))
    return {row[0]: list(row[1]) for row in kept.groupBy(group).agg(in_order).select(group, quantiles).collect()}


def _at_share(ordered: str, share: float) -> Column:
    """Linear interpolation between the two values next to a share of an ordered array."""
    last = F.size(ordered) - 1
    place = F.lit(float(share)) * last
    low = F.floor(place)
    below, above = F.get(ordered, low), F.get(ordered, F.least(low + 1, last))
    return below + (above - below) * (place - low)


def _solve(df: DataFrame, value: str, searches: list[_Search], group: str | None, limit: int) -> None:
    # The last step holds the inside of every open search at once.
    share = max(1, limit // len(searches))
    while True:
        wide = [s for s in searches if s.answer is None and s.inside > share]
        if not wide:
            break
        _narrow(df, value, wide, group)
    _finish(df, value, [s for s in searches if s.answer is None], group)


def _inside(df: DataFrame, value: str, searches: list[_Search], group: str | None) -> DataFrame:
    """Rows strictly inside the bounds of a search, once per search they belong to."""
    dtype = df.schema[value].dataType.simpleString()
    if group is None:
        bounds = F.array(*[
            F.struct(F.lit(s.key).alias("key"), F.lit(s.low).cast(dtype).alias("low"), F.lit(s.high).cast(dtype).alias("high"))
            for s in searches
        ])
        rows = df.select(F.col(value).alias("v"), F.explode(bounds).alias("s")).select("v", "s.*")
    else:
        gtype = df.schema[group].dataType.simpleString()
        # At most a few hundred rows: the groups are those of a cut result.
        table = df.sparkSession.createDataFrame(
            [(s.key, s.group, s.low, s.high) for s in searches], f"key int, g {gtype}, low {dtype}, high {dtype}"
        )
        rows = df.select(F.col(group).alias("g"), F.col(value).alias("v")).join(F.broadcast(table), "g")
    return rows.where(
        F.col("v").isNotNull()
        & (F.col("low").isNull() | (F.col("v") > F.col("low")))
        & (F.col("high").isNull() | (F.col("v") < F.col("high")))
    )


def _narrow(df: DataFrame, value: str, searches: list[_Search], group: str | None) -> None:
    """Move the bounds of every search closer to its rank; both new bounds are data values."""
    grid = ", ".join(f"{k / _GRID!r}D" for k in range(_GRID + 1))
    sketch = F.expr(f"percentile_approx(v, array({grid}), {_SKETCH_ACCURACY})")
    by_key = {s.key: s for s in searches}
    proposals = []
    rows = _inside(df, value, searches, group)
    place = {s.key: (s.rank - s.ahead) / max(s.inside - 1, 1) for s in searches}
    left = F.create_map(*[F.lit(x) for k, p in place.items() for x in (k, max(math.floor(p * _GRID) - 1, 0) + 1)])
    right = F.create_map(*[F.lit(x) for k, p in place.items() for x in (k, min(math.ceil(p * _GRID) + 1, _GRID) + 1)])
    sketched = rows.groupBy("key").agg(sketch.alias("points")).select(
        "key",
        F.element_at("points", F.element_at(left, F.col("key"))).alias("a"),
        F.element_at("points", F.element_at(right, F.col("key"))).alias("b"),
    )
    for row in sketched.collect():
        proposals.append((by_key[row["key"]], row["a"], row["b"]))
    counted = _count_around(rows, proposals, df.schema[value].dataType.simpleString())
    for search, a, b in proposals:
        _settle_side(search, a, b, counted[search.key])


def _count_around(rows: DataFrame, proposals: list, dtype: str) -> dict[int, Any]:
    """Exact counts below, at, between and at the two proposed values."""
    def lookup(values: dict) -> Column:
        entries = [x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(dtype))]
        return F.element_at(F.create_map(*entries), F.col("key"))

    v = F.col("v")
    rows = rows.withColumn("a", lookup({s.key: a for s, a, _ in proposals}))
    rows = rows.withColumn("b", lookup({s.key: b for s, _, b in proposals}))
    counts = rows.groupBy("key").agg(
        F.count_if(v < F.col("a")).alias("below"),
        F.count_if(v == F.col("a")).alias("at_a"),
        F.count_if((v > F.col("a")) & (v < F.col("b"))).alias("between"),
        F.count_if((v == F.col("b")) & (v > F.col("a"))).alias("at_b"),
    )
    return {row["key"]: row for row in counts.collect()}


def _settle_side(search: _Search, a: Any, b: Any, counted) -> None:
    position = search.rank - search.ahead
    above = search.inside - counted["below"] - counted["at_a"] - counted["between"] - counted["at_b"]
    steps = (
        (counted["below"], search.low, a), (counted["at_a"], a, a),
        (counted["between"], a, b), (counted["at_b"], b, b), (above, b, search.high),
    )
    passed = 0
    for size, low, high in steps:
        if position < passed + size:
            if low is not None and low == high:
                search.answer = low
            else:
                search.low, search.high = low, high
                search.ahead, search.inside = search.ahead + passed, size
            return
        passed += size


def _finish(df: DataFrame, value: str, searches: list[_Search], group: str | None) -> None:
    """Read the answers of narrow searches off their sorted distinct values."""
    if not searches:
        return
    by_key = {s.key: s for s in searches}
    positions = F.create_map(*[F.lit(x) for s in searches for x in (s.key, s.rank - s.ahead)])
    distinct = _inside(df, value, searches, group).groupBy("key", "v").agg(F.count("*").alias("n"))
    running = Window.partitionBy("key").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = F.element_at(positions, F.col("key"))
    answers = distinct.withColumn("upto", F.sum("n").over(running)).where(
        (F.col("upto") > position) & (F.col("upto") - F.col("n") <= position)
    )
    for row in answers.collect():
        by_key[row["key"]].answer = row["v"]


def counted_quantiles(df: DataFrame, shares: list[float], total: int, distinct: int, limit: int = DIRECT_LIMIT) -> list:
    """Linearly interpolated quantiles of values ``v`` that occur ``n`` times each, ``total`` times in all.

    Up to ``limit`` distinct values are put in order by one task. More are dealt out by ranges; counts per range tell in
    which of them a wanted rank lies, and only those are read again."""
    ranks = sorted({r for s in shares for r in ranks_of(total, s)[:2]})
    if distinct <= limit:
        rows = df.select("v", "n", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("before"))
    else:
        parts = math.ceil(distinct / max(limit // 4, 1))
        # stored, so that a part is the same rows each time it is read
        dealt = stored(df.select("v", "n").repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()))
        ahead, before = 0, []
        for part, size in dealt.groupBy("part").agg(F.sum("n")).orderBy("part").collect():
            if any(ahead <= rank < ahead + size for rank in ranks):
                before += [F.lit(part), F.lit(ahead).cast("bigint")]
            ahead += size
        starts = F.create_map(*before)
        rows = dealt.where(F.col("part").isin(before[::2])).withColumn("before", F.element_at(starts, F.col("part")))
    running = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = rows.withColumn("upto", F.col("before") + F.sum("n").over(running))
    hit = [(F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank) for rank in ranks]
    found = upto.agg(*[F.min(F.when(test, F.col("v"))) for test in hit]).first()
    at = dict(zip(ranks, found))
    return [at[low] + (at[high] - at[low]) * past for low, high, past in (ranks_of(total, s) for s in shares)]


def group_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, ``value``) with the exact median of every group, however many and however large the groups are.

    Distinct values with their counts are dealt out by ranges of (group, value), so that a large group lies in several
    parts and a frequent value is one row. Counts per part tell in which parts a median's two neighbours lie, and
    only those are read again."""
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    # stored, so that a part is the same rows each time it is read
    dealt = stored(counted.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    ahead = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("g", "part").agg(F.sum("n").alias("size")).select(
        "g", "part", "size", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("before"),
        F.sum("size").over(Window.partitionBy("g")).alias("total"),
    )
    first, second = F.expr("(total - 1) div 2"), F.expr("total div 2")
    ranks = parts.select("g", "part", "before", "size", F.explode(F.array(first, second)).alias("rank"))
    ranks = ranks.where("rank >= before and rank < before + size").groupBy("g", "part", "before").agg(F.collect_list("rank").alias("ranks"))
    running = Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.join(ranks, ["g", "part"]).withColumn("upto", F.col("before") + F.sum("n").over(running))
    hits = rows.select("g", "v", F.size(F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))).alias("times"))
    # of an odd number of values both ranks are the same and stand twice
    neighbours = hits.where("times > 0").groupBy("g").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return neighbours.select(F.col("g").alias(group), (F.col("a") + (F.col("b") - F.col("a")) * 0.5).alias("value"))
