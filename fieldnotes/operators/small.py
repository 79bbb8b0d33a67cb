"""Small tables the driver already holds, as plans that can be broadcast by size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of at most a few hundred literal rows."""
    layout = T.StructType.fromDDL(schema)
    if not rows:
        return spark.createDataFrame([], layout)
    records = [
        F.struct(*[F.lit(value).cast(f.dataType).alias(f.name) for value, f in zip(row, layout)]) for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*records)))
