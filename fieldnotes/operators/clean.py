"""Cleaning: cell text, headers, blank rows, filler columns, row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trimmed, trimmed_cell
from .columns import Field

FILLER_PREFIX = "Unnamed: "
ROW_ID = "_row_id"
# monotonically_increasing_id keeps the partition in the bits above this one.
_PARTITION_SHIFT = 33


def clean_headers(raw: list[str | None]) -> list[str]:
    """Strip header names, name the blank ones by position and number the repeats."""
    taken: set[str] = set()
    last_number: dict[str, int] = {}
    names = []
    for position, header in enumerate(raw, 1):
        base = (header or "").strip() or f"column_{position}"
        name = base
        while name in taken:
            last_number[base] = last_number.get(base, 1) + 1
            name = f"{base} ({last_number[base]})"
        taken.add(name)
        names.append(name)
    return names


def clean_cells(df: DataFrame, names: list[str], missing_tokens: bool = False) -> tuple[DataFrame, list[Field]]:
    """Give columns physical names and trim every text cell; blank cells become NULL.

    Physical names (``c0000``, ``c0001``, …) keep display names with dots, back-ticks
    or only a difference in case out of the plans.
    """
    physical = [f"c{k:04d}" for k in range(len(names))]
    df = df.toDF(*physical)
    clean = trimmed_cell if missing_tokens else trimmed
    cells, fields = [], []
    for k, (phys, column) in enumerate(zip(physical, df.schema)):
        value = F.col(phys)
        dtype = column.dataType
        if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
            value, dtype = clean(value), T.StringType()
        cells.append(value.alias(phys))
        fields.append(Field(k, names[k], phys, dtype))
    return df.select(*cells), fields


def has_value(fields: list[Field]) -> Column:
    """True for rows with at least one value."""
    tests = [f.raw.isNotNull() for f in fields]
    # Joined in pairs, so that wide tables don't make a deep expression.
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + (tests[-1:] if len(tests) % 2 else [])
    return tests[0]


def with_row_id(df: DataFrame) -> DataFrame:
    """Add an id that grows in row order, unless the table was stored with one."""
    return df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())


def moves_rows(df: DataFrame) -> bool:
    """Whether rows are dealt anew on the way, so that two plans over the same table may number them differently."""
    return any(node.startswith("Exchange") for node in _plan_nodes(df._jdf.queryExecution().executedPlan()))


def _plan_nodes(plan) -> list[str]:
    """Names of a physical plan's nodes. A broadcast is another node than a shuffle, and names of columns or files are
    none."""
    names = [plan.nodeName()]
    children = plan.children()
    below = [plan.initialPlan()] if names[0].startswith("AdaptiveSparkPlan") else [children.apply(k) for k in range(children.size())]
    for child in below:
        names += _plan_nodes(child)
    return names


def _partition_of_id() -> Column:
    return F.shiftright(F.col(ROW_ID), _PARTITION_SHIFT).cast("int")


def partition_starts(df: DataFrame) -> DataFrame:
    """Number of rows ahead of each partition; one small row per partition of the scan."""
    partition = _partition_of_id() if ROW_ID in df.columns else F.spark_partition_id()
    sizes = df.groupBy(partition.alias("partition")).agg(F.count("*").alias("size"))
    ahead = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("partition", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start"))


def with_row_number(identified: DataFrame, starts: DataFrame) -> DataFrame:
    """Replace the row id by the 0-based row number ``_row``.

    The row id holds the partition and the position inside it, so adding the
    rows ahead of the partition numbers the table without moving any row.
    """
    inside = F.col(ROW_ID).bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1))
    return (
        identified.withColumn("partition", _partition_of_id())
        .join(starts, "partition")
        .withColumn("_row", F.col("start") + inside)
        .drop("partition", "start", ROW_ID)
    )


def value_counts(df: DataFrame, fields: list[Field]) -> dict[str, int]:
    """Number of values in each of the given columns."""
    return df.agg(*[F.count(f.raw).alias(f.physical) for f in fields]).first().asDict()


def count_rows(df: DataFrame, fields: list[Field]) -> tuple[int, int]:
    """All rows, and the rows with at least one value.

    One column without gaps proves that no row is blank, so the wide scan is made
    only when the cheapest column has gaps.
    """
    if not fields:
        return 0, 0
    witness = next((f for f in fields if not isinstance(f.dtype, T.StringType)), fields[0])
    total, filled = df.agg(F.count("*"), F.count(witness.raw)).first()
    if filled < total:
        filled = df.where(has_value(fields)).count()
    return total, filled
