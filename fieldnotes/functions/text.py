"""Text cleaning and the text form of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that counts as white space around a cell.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Cell texts that a delimited file uses for "missing".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Fixed value: the separator between two cells of one row's search text.
CELL_SEPARATOR = "\x1f"


def trimmed(value: Column) -> Column:
    """Strip white space from both ends; blank becomes NULL.

    Stripping a set of characters is costly, so only cells with white space at an
    end go through it.
    """
    codes = [ord(c) for c in WHITESPACE]
    loose = F.ascii(value).isin(codes) | F.ascii(F.right(value, F.lit(1))).isin(codes)
    bare = F.when(loose, F.btrim(value, F.lit(WHITESPACE))).otherwise(value)
    return F.nullif(bare, F.lit(""))


def trimmed_cell(value: Column) -> Column:
    """``trimmed`` for a delimited cell: the missing tokens become NULL as well."""
    return F.when(~value.isin(*MISSING_TOKENS), trimmed(value))


def _plain_word(java: Column) -> Column:
    """``0.0`` and the words for infinity and not-a-number in their short form."""
    return F.when(java.contains("Infinity"), F.replace(java, F.lit("Infinity"), F.lit("inf"))).otherwise(java)


def double_text(value: Column) -> Column:
    """Shortest decimal text of a double: ``10000000.0``, ``1e+16``, ``1e-05``.

    Spark prints ``1.0E7`` from ten million on, so the digits of that form are
    laid out again around the decimal point.
    """
    java = value.cast("string")
    size = F.abs(value)
    sign = F.when(java.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_replace(F.split_part(java, F.lit("E"), F.lit(1)), "^-", "")
    exponent = F.split_part(java, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    whole = F.rpad(digits, exponent + 1, "0")
    rest = F.substr(digits, exponent + 2)
    shifted_left = F.concat(sign, whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
    shifted_right = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    power = F.concat(
        sign, F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"),
        F.when(exponent < 0, "-").otherwise("+"),
        F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), "0"),
    )
    return (
        F.when((size >= 1e-3) & (size < 1e7), java)
        .when(exponent.isNull(), _plain_word(java))
        .when((exponent >= 0) & (exponent < 16), shifted_left)
        .when((exponent < 0) & (exponent >= -4), shifted_right)
        .otherwise(power)
    )


def cell_text(value: Column, dtype: T.DataType) -> Column:
    """The text of one raw cell, as searching sees it; NULL stays NULL."""
    if isinstance(dtype, T.DoubleType):
        return double_text(value)
    if isinstance(dtype, T.FloatType):
        return double_text(value.cast("string").try_cast("double"))
    if isinstance(dtype, T.BooleanType):
        return F.when(value, "True").otherwise(F.when(~value, "False"))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def row_text(cells: list[tuple[Column, T.DataType]]) -> Column:
    """Lower-cased text of a whole row. A match can't span two cells."""
    parts = [F.coalesce(cell_text(value, dtype), F.lit("")) for value, dtype in cells]
    return F.lower(F.concat_ws(CELL_SEPARATOR, *parts))
