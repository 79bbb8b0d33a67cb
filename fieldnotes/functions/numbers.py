"""Numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency signs and the text shapes that decide how a comma is read.
CURRENCY = "$€£¥₹"
THOUSANDS_COMMA = rf"^\(?[-+]?[{CURRENCY}]?\d{{1,3}}(,\d{{3}})+(\.\d+)?%?\)?$"
DECIMAL_COMMA = rf"^\(?[-+]?[{CURRENCY}]?\d*,\d+%?\)?$"
EURO_STYLE = rf"^\(?[-+]?[{CURRENCY}]?\d{{1,3}}(\.\d{{3}})+(,\d+)?%?\)?$"
LEADING_ZERO_CODE = r"^0\d+$"

WHOLE_NUMBER = r"^[+-]?[0-9]+$"
PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_WORD = r"^[+-]?(?i:inf|infinity)$"
_LONGEST_INFINITY = len("+infinity")
# A text with any other character can't be a number under any style, so the
# costlier patterns are not tried on it.
NUMBER_CHARACTERS = rf"^[0-9eE+\-.,()%{CURRENCY}\s]+$"

# First characters that a text of those patterns can have.
_FIRST_CHARACTERS = [ord(c) for c in "0123456789eE+-.,()%" + CURRENCY]

# How a column writes its numbers.
PLAIN, BARE, EURO, THOUSANDS, DECIMAL = "plain", "bare", "euro", "thousands", "decimal"


def could_be_number(text: Column) -> Column:
    """A cheap test that every readable number passes; most text leaves at its first character."""
    return (F.ascii(text).isin(_FIRST_CHARACTERS) & text.rlike(NUMBER_CHARACTERS)) | is_infinity(text)


def is_plain_number(text: Column) -> Column:
    """True for a plain finite number such as ``-1.5e3``."""
    return text.rlike(PLAIN_NUMBER) & (F.abs(text.try_cast("double")) < F.lit(float("inf")))


def plain_number(text: Column) -> Column:
    """The value of a plain finite number; NULL for anything else."""
    return F.when(is_plain_number(text), text.try_cast("double"))


def is_infinity(text: Column) -> Column:
    return (F.length(text) <= _LONGEST_INFINITY) & text.rlike(INFINITY_WORD)


def infinity(text: Column) -> Column:
    """Signed infinity for the words that mean it."""
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    return F.when(is_infinity(text), sign * F.lit(float("inf")))


def plain_text(text: Column, style: str) -> tuple[Column, Column]:
    """A decorated number as a plain one, and whether brackets make it negative."""
    if style == PLAIN:
        return text, F.lit(False)
    if style == EURO:
        text = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    elif style == THOUSANDS:
        text = F.replace(text, F.lit(","), F.lit(""))
    elif style == DECIMAL:
        text = F.replace(text, F.lit(","), F.lit("."))
    return strip_decoration(text), text.rlike(r"^\(.*\)$")


def styled_number(text: Column, style: str) -> Column:
    """The value of a decorated number: currency, percent, brackets for negative."""
    return signed_number(*plain_text(text, style), style)


def signed_number(plain: Column, negative: Column, style: str) -> Column:
    """The value of a text that ``plain_text`` made plain."""
    number = plain_number(plain)
    return number if style == PLAIN else F.when(negative, F.lit(-1.0)).otherwise(F.lit(1.0)) * number


def signed_decimal(plain: Column, negative: Column) -> Column:
    """That value without the rounding of a double; NULL where it has more than 28 digits ahead of the point or more than
    10 behind it."""
    exact, finer = plain.try_cast("decimal(38,10)"), plain.try_cast("decimal(38,18)")
    vanished = (exact == 0) & (plain.try_cast("double") != 0)
    same = F.when(is_plain_number(plain) & F.coalesce(finer == exact, F.lit(True)) & ~vanished, exact)
    return F.when(negative, -same).otherwise(same)


def strip_decoration(text: Column) -> Column:
    """Drop white space, currency and percent signs, and brackets around the whole."""
    return F.btrim(F.regexp_replace(text, rf"(?U)[\s{CURRENCY}%]", ""), F.lit("()"))
