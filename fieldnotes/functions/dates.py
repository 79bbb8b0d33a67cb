"""Dates written as text, read as UTC wall time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text shapes a date column is made of.
DATE_LIKE = (
    r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"
    r"|^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}( \d{1,2}:\d{2}(:\d{2})?( ?[AaPp][Mm])?)?$"
    r"|^[A-Za-z]{3,9}\.? \d{1,2},? \d{4}$"
    r"|^\d{1,2} [A-Za-z]{3,9}\.? \d{4}$"
)
# The names a month goes by.
MONTHS = (
    "jan|january", "feb|february", "mar|march", "apr|april", "may", "jun|june",
    "jul|july", "aug|august", "sep|sept|september", "oct|october", "nov|november", "dec|december",
)

# The range a nanosecond timestamp can hold.
EARLIEST, LATEST = "1677-09-21 00:12:43.145225", "2262-04-11 23:47:16.854775"

# How a column writes its dates.
ISO, MIXED = "iso", "mixed"

# What a date text can consist of, and how to see it. A column is read with the
# rules of the shapes it has, so plain columns take few of them.
SHAPES = {
    "year_first": r"^\d{4}",
    "offset": r"[ T]\d.*(?:Z|[+-]\d{2}(?::?\d{2})?)$",
    "day_month": r"^\d{1,2}[-/.]",
    "short_year": r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{1,2}(?: |$)",
    "half_day": r"[AaPp][Mm]$",
    "named": r"[A-Za-z]{3}",
}

# Rules rewrite a text to ``=year-month-day hour:minute:second``, which Spark can
# read with its last parts left out. One chain of rewriting keeps a cell one
# expression, where taking pieces apart would repeat the text once per piece.
_YEAR_FIRST = r"^(\d{4})(?:([-/. ])(\d{1,2})(?:\2(\d{1,2}))?|(\d{2})(\d{2}))?"
_YEAR_FIRST_RULES = (
    (_YEAR_FIRST + r"(?:[ T](\d{1,2}(?::\d{1,2}(?::\d{1,2}(?:\.\d+)?)?)?))?$", "=$1-$3$5-$4$6 $7"),
    (r"(?<=-)(?=[- ])", "1"),
)
_DAY_FIRST_RULE = (r"^(1[3-9]|2\d|3[01])[-/.](\d{1,2})[-/.](\d{2}|\d{4})(?=$| )", "$2/$1/$3")
_SHORT_YEAR_FIRST_RULE = (r"^(3[2-9]|[4-9]\d)[-/.](\d{1,2})[-/.](\d{1,2})(?=$| )", "$2/$3/$1")
_MONTH_FIRST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})"
_MONTH_FIRST_RULE = (_MONTH_FIRST + r"(?: (\d{1,2}:\d{2}(?::\d{2})?))?$", "=$3-$1-$2 $4")

# Texts with an offset to UTC get all of their parts and an offset:
# ``=year-month-dayThour:minute:second+hour:minute``.
_OFFSET_RULES = (
    (
        _YEAR_FIRST + r"[ T](\d{1,2})(?::(\d{1,2})(?::(\d{1,2}(?:\.\d+)?))?)? ?(?:Z|([+-]\d{2}):?(\d{2})?)$",
        "=$1-$3$5-$4$6T$7:$8:$9Z$10:$11",
    ),
)
# Half past ten in the evening is half past ten, twelve hours west.
_HALF_DAY_RULES = (
    (r" 12:(\d{2}(?::\d{2})? ?[AaPp][Mm])$", " 0:$1"),
    (_MONTH_FIRST + r" (0?\d|1[01]):(\d{2})(?::(\d{2}))? ?[Aa][Mm]$", "=$3-$1-$2T$4:$5:$6Z:"),
    (_MONTH_FIRST + r" (0?\d|1[01]):(\d{2})(?::(\d{2}))? ?[Pp][Mm]$", "=$3-$1-$2T$4:$5:$6Z-12:"),
)
_GAP_RULES = ((r"(?<=-)(?=[-T])", "1"), (r"(?<=[T:])(?=[:Z]|$)", "0"), (r"Z(?=:)", "+0"), (r"Z", ""))


# Every text that the rules rewrite starts with a digit or is a month with day and year.
_DIGIT_FIRST = r"^(?:\d{4}(?:$|[-/. \d])|\d{1,2}[-/.]\d{1,2}[-/.]\d{2}|\d{1,2} [A-Za-z]{3,9}\.? \d{4}$)"
_NAME_FIRST = r"^[A-Za-z]{3,9}\.? \d{1,2},? \d{4}$"
_LONGEST_NAME_FIRST = len("September. 30, 2024")


def could_be_date(text: Column) -> Column:
    """A cheap test that every readable date passes; most text leaves at its first or last character."""
    digit_first = F.ascii(text).between(ord("0"), ord("9"))
    name_first = (F.length(text) <= _LONGEST_NAME_FIRST) & F.right(text, F.lit(1)).between("0", "9")
    return (digit_first & text.rlike(_DIGIT_FIRST)) | (~digit_first & name_first & text.rlike(_NAME_FIRST))


def _rewrite(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _short_year_rules() -> list[tuple[str, str]]:
    """A two-digit year means the one within fifty years of today."""
    today = date.today().year
    by_century: dict[int, list[str]] = {}
    for short in range(100):
        year = today // 100 * 100 + short
        year += 100 if year < today - 50 else -100 if year >= today + 50 else 0
        by_century.setdefault(year // 100, []).append(f"{short:02d}")
    return [
        (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.]({'|'.join(shorts)})(?=$| )", f"$1/$2/{century}$3")
        for century, shorts in by_century.items()
    ]


def _named_rules() -> list[tuple[str, str]]:
    """``Jan 5, 2024`` and ``5 January 2024``, month by month."""
    return [
        (rf"(?i)^(?:(?:{names})\.? (\d{{1,2}}),?|(\d{{1,2}}) (?:{names})\.?) (\d{{4}})$", f"=$3-{number}-$1$2")
        for number, names in enumerate(MONTHS, 1)
    ]


def shape_bits(text: Column) -> Column:
    """A bit for each shape a text has."""
    bits = [F.when(text.rlike(pattern), F.lit(1 << k)).otherwise(F.lit(0)) for k, pattern in enumerate(SHAPES.values())]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def shapes_of(bits: int) -> tuple[str, ...]:
    return tuple(shape for k, shape in enumerate(SHAPES) if bits >> k & 1)


def _month_first_rules(shapes: Sequence[str]) -> list[tuple[str, str]]:
    """Bring day, month and year into the order of ``month/day/year``, with four digits."""
    rules = [_DAY_FIRST_RULE]
    if "short_year" in shapes:
        rules += [_SHORT_YEAR_FIRST_RULE, *_short_year_rules()]
    return rules


def _local(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return F.regexp_extract(_rewrite(text, *rules), "^=(.*)$", 1).try_cast("timestamp_ntz")


def _zoned(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    instant = F.regexp_extract(_rewrite(text, *rules, *_GAP_RULES), "^=(.*)$", 1).try_cast("timestamp")
    return from_epoch_micros(F.unix_micros(instant))


def text_timestamp(text: Column, style: str, shapes: Sequence[str] = tuple(SHAPES)) -> Column:
    """The UTC wall time a text names: year-first dates only, or any of the known shapes.

    Of two small numbers the first is the month unless it can't be one. What a
    nanosecond timestamp can't hold is missing.
    """
    moments = []
    if "year_first" in shapes:
        moments.append(_local(text, _YEAR_FIRST_RULES))
        if "offset" in shapes:
            moments.append(_zoned(text, _OFFSET_RULES))
    if style == MIXED:
        if "day_month" in shapes:
            order = _month_first_rules(shapes)
            moments.append(_local(text, [*order, _MONTH_FIRST_RULE]))
            if "half_day" in shapes:
                moments.append(_zoned(text, [*order, *_HALF_DAY_RULES]))
        if "named" in shapes:
            moments.append(_local(text, _named_rules()))
    if not moments:
        return F.lit(None).cast("timestamp_ntz")
    moment = F.coalesce(*moments)
    low, high = (F.lit(bound).cast("timestamp_ntz") for bound in (EARLIEST, LATEST))
    return F.when(moment.between(low, high), moment)


_EPOCH = "1970-01-01 00:00:00"


def epoch_micros(moment: Column) -> Column:
    """Microseconds since 1970 of a wall time, whatever the session zone."""
    elapsed = moment - F.lit(_EPOCH).cast("timestamp_ntz")
    seconds = elapsed.cast("interval second").cast("decimal(18,6)")
    return (seconds * 1_000_000).cast("bigint")


def from_epoch_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.lit(_EPOCH).cast("timestamp_ntz"))
