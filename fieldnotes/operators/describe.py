"""Statistics of one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import epoch_micros, from_epoch_micros
from ..functions.rounding import rounded
from .columns import BOOLEAN, CATEGORICAL, DATETIME, NUMERIC, TEXT, Profile
from .profile import exact_sum
from .quantiles import counted_quantiles, exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]
SECONDS_PER_DAY = 86_400


def ordered_values(ds, p: Profile) -> DataFrame:
    """The values ``v`` of a column as numbers quantiles can work on; microseconds for times."""
    values = ds.values("v", v=p.name)
    return values.select(epoch_micros(F.col("v")).alias("v")) if p.kind == DATETIME else values


def quartiles(ds, p: Profile) -> list:
    """First quartile, median and third quartile, kept on the dataset."""
    known = ds.known_quartiles
    if p.field.position not in known:
        counted = ds.counted(p.field)
        if counted is None:
            found = exact_quantiles(ordered_values(ds, p), "v", {None: p.valid}, QUARTILES)[None]
        else:
            value = epoch_micros(F.col("moment")) if p.kind == DATETIME else F.col("number")
            found = counted_quantiles(counted.select(value.alias("v"), "n"), QUARTILES, p.valid, p.unique)
        known[p.field.position] = found
    return known[p.field.position]


def _numeric(ds, p: Profile) -> DataFrame:
    n, v = p.valid, F.col("v")
    if "skewness" in p.facts:
        moments = [F.lit(p.facts[name]).cast("double").alias(name) for name in ("sum", "std", "min", "max", "skewness")]
        facts = ds.spark.range(0, 1, 1, 1).select(*moments)
    else:
        facts = ds.values("v", v=p.name).agg(
            exact_sum(v).alias("sum"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.skewness(v).alias("skewness"),
        )
    q1, median, q3 = (F.lit(float(q)) for q in quartiles(ds, p))
    # From the population figure to the one corrected for sample size; a constant has none.
    correction = (n * (n - 1)) ** 0.5 / (n - 2) if n >= 3 else None
    skewness = F.coalesce("skewness", F.lit(0.0)) * F.lit(correction).cast("double")
    return facts.select(
        rounded(F.col("sum") / n).alias("mean"),
        rounded(F.col("std")).alias("std"),
        rounded(F.col("std") / n ** 0.5).alias("sem"),
        rounded(F.col("min")).alias("min"),
        rounded(q1).alias("q1"),
        rounded(median).alias("median"),
        rounded(q3).alias("q3"),
        rounded(F.col("max")).alias("max"),
        rounded(q3 - q1).alias("iqr"),
        rounded(F.col("max") - F.col("min")).alias("range"),
        rounded(F.col("sum")).alias("sum"),
        rounded(skewness).alias("skewness"),
    )


def _label(ds, p: Profile) -> DataFrame:
    mode_count = p.facts["mode_count"]
    return ds.cells.agg(F.avg(F.char_length(ds.typed(p.name))).alias("length")).select(
        F.lit(p.facts["mode"]).alias("mode"),
        F.lit(mode_count).cast("bigint").alias("mode_count"),
        rounded(F.lit(mode_count / p.valid * 100), 2).alias("mode_pct"),
        rounded(F.col("length"), 1).alias("mean_length"),
    )


def _boolean(ds, p: Profile) -> DataFrame:
    flag = ds.typed(p.name)
    return ds.cells.agg(F.count_if(flag).alias("true_count"), F.count_if(~flag).alias("false_count")).select(
        "true_count", "false_count", rounded(F.col("true_count") / p.valid * 100, 2).alias("true_pct")
    )


def _datetime(ds, p: Profile) -> DataFrame:
    first, last = p.facts["first"], p.facts["last"]
    days = (last - first).total_seconds() / SECONDS_PER_DAY
    return ds.spark.range(0, 1, 1, 1).select(
        F.lit(first).cast("timestamp_ntz").alias("min"),
        F.lit(last).cast("timestamp_ntz").alias("max"),
        from_epoch_micros(F.lit(int(quartiles(ds, p)[1]))).alias("median"),
        rounded(F.lit(days), 2).alias("span_days"),
    )


_BY_KIND = {NUMERIC: _numeric, CATEGORICAL: _label, TEXT: _label, BOOLEAN: _boolean, DATETIME: _datetime}


def _base(p: Profile) -> list[Column]:
    return [
        F.lit(p.name).alias("column"),
        F.lit(p.kind).alias("kind"),
        F.lit(p.valid).cast("bigint").alias("valid"),
        F.lit(p.missing).cast("bigint").alias("missing"),
        F.lit(round(p.missing_pct, 2)).alias("missing_pct"),
        F.lit(p.unique).cast("bigint").alias("unique"),
    ]


def describe(ds, column: str) -> DataFrame:
    """One row of statistics; which ones depends on the kind of the column."""
    p = ds.profile(column)
    if p.kind not in _BY_KIND or not p.valid:
        return ds.spark.range(0, 1, 1, 1).select(*_base(p))
    return _BY_KIND[p.kind](ds, p).select(*_base(p), "*")


# Statistics in the order a report lists them.
_NUMERIC_LINES = (
    ("Mean", "mean"), ("Std. deviation", "std"), ("Std. error of mean", "sem"), ("Skewness", "skewness"),
    ("Sum", "sum"), ("Minimum", "min"), ("1st quartile", "q1"), ("Median", "median"),
    ("3rd quartile", "q3"), ("Maximum", "max"), ("Valid", "valid"), ("Missing", "missing"),
)
_COMMON_LINES = (("Valid", "valid"), ("Missing", "missing"), ("Distinct values", "unique"), ("Missing (%)", "missing_pct"))


def descriptive_table(ds, column: str) -> DataFrame:
    """The statistics a report prints, one per row."""
    lines = _NUMERIC_LINES if ds.profile(column).kind == NUMERIC else _COMMON_LINES
    entries = F.array(*[
        F.struct(F.lit(k).alias("position"), F.lit(title).alias("statistic"), F.col(name).cast("double").alias("value"))
        for k, (title, name) in enumerate(lines, 1)
    ])
    return describe(ds, column).select(F.explode(entries).alias("line")).select("line.*")
