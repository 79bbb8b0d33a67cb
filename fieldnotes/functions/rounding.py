"""Rounding and JSON-safe values for results that leave the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(value: Column, digits: int = 4) -> Column:
    """Round a double the way decimal printing does: by its exact binary value, ties to even.

    ``F.round`` rounds the shortest printed decimal half-up and so disagrees on
    values such as 2.675. Meant for the few result rows of a report, never for
    intermediate values.
    """
    pattern = F.lit("0." + "0" * digits if digits else "0")
    return F.call_function("format_number", value.cast("double"), pattern).try_cast("double") + F.lit(0.0)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole`` as a rounded percentage; 0 when there is nothing to divide by."""
    return F.when(whole > 0, rounded(part / whole * 100.0, digits)).otherwise(F.lit(0.0))


def finite(value: Column) -> Column:
    """Turn NaN and the infinities into NULL."""
    as_double = value.cast("double")
    return F.when(F.abs(as_double) < F.lit(float("inf")), as_double)


def finite_or_null(df: DataFrame) -> DataFrame:
    """Make every column of a result safe to write as JSON.

    Non-finite numbers become NULL, decimals become doubles, dates and times
    become ISO text and binary becomes text.
    """
    return df.select(*[_jsonable(F.col(f"`{f.name.replace('`', '``')}`"), f.dataType).alias(f.name) for f in df.schema])


def _jsonable(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return finite(value)
    if isinstance(dtype, T.BinaryType):
        return F.make_valid_utf8(value.cast("string"))
    if isinstance(dtype, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        seconds = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(value, "SSSSSS")
        return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: _jsonable(item, dtype.elementType))
    if isinstance(dtype, T.StructType):
        return F.when(
            value.isNotNull(),
            F.struct(*[_jsonable(value.getField(f.name), f.dataType).alias(f.name) for f in dtype]),
        )
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, item: _jsonable(item, dtype.valueType))
    return value
