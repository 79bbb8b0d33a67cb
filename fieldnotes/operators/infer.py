"""Type inference: what a text column means, decided from all of its rows.

Aggregates collect a fixed set of counts per text column, the driver picks a
reading for each column from those counts, and the typed view stays a lazy
projection. Columns that may hold numbers or dates are counted by their distinct
texts once, and every costly pattern is tried on those.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, flags, numbers
from ..session import stored
from .columns import BOOLEAN, DATETIME, EMPTY, LABEL, NUMERIC, Field, Reading

# The shares and sizes that decide a kind.
NUMERIC_SHARE = 0.95
DATETIME_SHARE = 0.90


def long_form(df: DataFrame, **values: dict[int, Column]) -> DataFrame:
    """One row per cell: ``i`` names the column, the keyword columns hold its value.

    A long table keeps the aggregate the same size for any number of columns and
    reads the source once for all of them.
    """
    indices = sorted({i for by_column in values.values() for i in by_column})
    slots = [F.lit(len(indices))]
    for i in indices:
        slots.append(F.lit(i))
        slots += [by_column.get(i, F.lit(None)).cast(_SLOT_TYPES[slot]) for slot, by_column in values.items()]
    return df.select(F.stack(*slots).alias("i", *values))


_SLOT_TYPES = {"text": "string", "number": "double", "moment": "timestamp_ntz", "whole": "bigint"}


def _cells(df: DataFrame, fields: list[Field]) -> DataFrame:
    return long_form(df, text={f.position: f.raw for f in fields}).where("text is not null")


def _by_column(rows: DataFrame) -> dict[int, dict]:
    return {row["i"]: row.asDict() for row in rows.collect()}


def screen(df: DataFrame, fields: list[Field]) -> dict[int, dict]:
    """Cheap counts that rule out most readings of most text columns."""
    text, word = F.col("text"), F.col("word")
    cells = long_form(df, text={f.position: f.raw for f in fields}).withColumn("word", flags.word_bit(text))
    return _by_column(cells.groupBy("i").agg(
        F.count("*").alias("rows"),
        F.count("text").alias("valid"),
        F.count_if(numbers.could_be_number(text)).alias("numberish"),
        F.count_if(dates.could_be_date(text)).alias("datable"),
        F.count_if(text.contains(",")).alias("comma"),
        F.count_if(text.contains(".")).alias("dot"),
        F.count("word").alias("flag_words"),
        F.bit_count(F.bit_or("word")).alias("distinct_flag_words"),
        F.count_if(F.when(word.isNotNull(), text.isin(*flags.READER_WORDS))).alias("reader_flags"),
    ))


def text_counts(df: DataFrame, fields: list[Field]) -> DataFrame:
    """The distinct texts of columns with their occurrences ``n``, in one scan and one shuffle."""
    return _cells(df, fields).groupBy("i", "text").agg(F.count("*").alias("n"))


def _texts_of(texts: DataFrame, fields: list[Field]) -> DataFrame:
    return texts.where(F.col("i").isin([f.position for f in fields]))


def number_facts(texts: DataFrame, fields: list[Field]) -> dict[int, dict]:
    """Counts of cells that settle whether and how columns write numbers, from their distinct texts."""
    text, comma = F.col("text"), F.col("text").contains(",")
    # A cell with a comma parses when it has the shape that settles its style,
    # so only cells without one have to be tried, with and without their dots.
    bare = F.when(~comma, numbers.strip_decoration(text))
    undotted = F.when(
        ~comma & text.contains("."), numbers.strip_decoration(F.replace(text, F.lit("."), F.lit("")))
    )
    # The generator keeps the pieces from being taken again for every use.
    pieces = F.stack(F.lit(1), "i", "text", "n", comma, bare, undotted).alias("i", "text", "n", "comma", "bare", "undotted")
    comma = F.col("comma")

    def cells(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    return _by_column(_texts_of(texts, fields).select(pieces).groupBy("i").agg(
        cells(text.rlike(numbers.LEADING_ZERO_CODE)).alias("zero_codes"),
        cells(numbers.is_plain_number(text) | numbers.is_infinity(text)).alias("plain"),
        cells(text.rlike(numbers.WHOLE_NUMBER) & text.try_cast("bigint").isNotNull()).alias("whole"),
        cells(comma & text.contains(".")).alias("comma_dot"),
        cells(comma & text.rlike(numbers.EURO_STYLE)).alias("euro_shape"),
        cells(comma & text.rlike(numbers.THOUSANDS_COMMA)).alias("thousands_shape"),
        cells(comma & text.rlike(numbers.DECIMAL_COMMA)).alias("decimal_shape"),
        cells(numbers.is_plain_number(F.col("bare"))).alias("bare"),
        cells(numbers.is_plain_number(F.coalesce("undotted", "bare"))).alias("euro"),
    ))


def date_facts(texts: DataFrame, fields: list[Field]) -> dict[int, dict]:
    """What the date-like texts of each column look like."""
    text = F.col("text")
    return _by_column(_texts_of(texts, fields).where(dates.could_be_date(text)).groupBy("i").agg(
        F.count_if(text.rlike(dates.DATE_LIKE)).alias("dateish"),
        F.bit_or(dates.shape_bits(text)).alias("shapes"),
    ))


def date_evidence(df: DataFrame, f: Field, shapes: tuple[str, ...], texts: DataFrame | None = None) -> dict:
    """Over all distinct texts of a column: the share that looks like a date, and the cells that can be read as one in
    each style. Every distinct text is looked at once; ``texts`` holds them if they are counted already."""
    text = F.col("text")
    texts = _texts_of(text_counts(df, [f]) if texts is None else texts, [f])
    styles = (dates.ISO, dates.MIXED) if set(shapes) - {"year_first", "offset"} else (dates.ISO,)
    moments = {style: F.when(dates.could_be_date(text), dates.text_timestamp(text, style, shapes)) for style in styles}
    read = texts.select(F.stack(F.lit(1), text.rlike(dates.DATE_LIKE), F.col("n"), *moments.values()).alias("dateish", "n", *moments))
    cells = [F.coalesce(F.sum(F.when(F.col(style).isNotNull(), F.col("n"))), F.lit(0)).alias(style) for style in styles]
    return read.agg(F.avg(F.col("dateish").cast("int")).alias("share"), *cells).first().asDict()


def number_style(facts: dict) -> str | None:
    """How the column writes numbers, or None when it is not numeric."""
    if facts["zero_codes"]:
        return None
    if facts["plain"] == facts["valid"]:
        return numbers.PLAIN
    style, parsed = numbers.BARE, facts["bare"]
    if facts["comma"]:
        parsed += facts["comma"]
        if facts["euro_shape"] == facts["comma"] and facts["comma_dot"]:
            style, parsed = numbers.EURO, facts["comma"] + facts["euro"]
        elif facts["thousands_shape"] == facts["comma"]:
            style = numbers.THOUSANDS
        elif facts["decimal_shape"] == facts["comma"] and not facts["dot"]:
            style = numbers.DECIMAL
        else:
            return None
    return style if parsed >= NUMERIC_SHARE * facts["valid"] else None


def read_dates(df: DataFrame, f: Field, facts: dict, texts: DataFrame) -> Reading | None:
    """The reading of a column of dates, or None when it holds something else."""
    shapes = dates.shapes_of(facts["shapes"])
    if not facts["dateish"]:
        return None
    evidence = date_evidence(df, f, shapes, texts)
    if evidence["share"] < DATETIME_SHARE:
        return None
    for style in (dates.ISO, dates.MIXED):
        if evidence.get(style, 0) >= DATETIME_SHARE * facts["valid"]:
            return Reading(DATETIME, style, shapes)
    return None


def cell_type(facts: dict) -> str:
    """The type a reader of delimited files gives a column by itself."""
    if "plain" in facts and not facts["zero_codes"] and facts["plain"] == facts["valid"]:
        return "bigint" if facts["whole"] == facts["rows"] else "double"
    return "boolean" if facts["reader_flags"] == facts["valid"] else ""


@dataclass
class Found:
    """What inference knows: the readings, the distinct texts of columns that may hold numbers or dates, and the number of
    rows where a column without gaps proves it."""

    readings: dict[int, Reading] = field(default_factory=dict)
    texts: dict[int, DataFrame] = field(default_factory=dict)
    rows: int | None = None


def read_text(df: DataFrame, fields: list[Field]) -> Found:
    """The readings of text columns, each narrowed down with as few passes as it needs.

    The first pass screens all columns; the distinct texts of those that are still
    open are counted and stored, and the costlier patterns look at them only.
    """
    facts = {i: fact for i, fact in screen(df, fields).items() if fact["valid"]}
    readings = {f.position: Reading(EMPTY) for f in fields if f.position not in facts}
    open_fields = [f for f in fields if f.position in facts]

    def still_possible(count: str, share: float) -> list[Field]:
        return [
            f for f in open_fields
            if f.position not in readings and facts[f.position][count] >= share * facts[f.position]["valid"]
        ]

    maybe_numbers = still_possible("numberish", NUMERIC_SHARE)
    maybe_dates = still_possible("datable", DATETIME_SHARE)
    undecided = [f for f in open_fields if f in maybe_numbers or f in maybe_dates]
    texts = stored(text_counts(df, undecided)) if undecided else None
    if maybe_numbers:
        for i, found in number_facts(texts, maybe_numbers).items():
            facts[i].update(found)
            style = number_style(facts[i])
            if style:
                readings[i] = Reading(NUMERIC, style)
    for f in open_fields:
        fact = facts[f.position]
        if f.position not in readings and fact["flag_words"] == fact["valid"] and fact["distinct_flag_words"] <= 2:
            readings[f.position] = Reading(BOOLEAN)
    maybe_dates = still_possible("datable", DATETIME_SHARE)
    if maybe_dates:
        by_position = {f.position: f for f in maybe_dates}
        for i, found in date_facts(texts, maybe_dates).items():
            reading = read_dates(df, by_position[i], {**facts[i], **found}, texts)
            if reading:
                readings[i] = reading
    for f in open_fields:
        reading = readings.setdefault(f.position, Reading(LABEL))
        reading.cell_type = cell_type(facts[f.position])
    rows = next((fact["rows"] for fact in facts.values() if fact["rows"] == fact["valid"]), None)
    return Found(readings, {f.position: _texts_of(texts, [f]) for f in undecided}, rows)


def read_fields(df: DataFrame, fields: list[Field]) -> Found:
    """The reading of every given field; native types settle without a job."""
    text_fields = [f for f in fields if f.native_kind is None]
    found = read_text(df, text_fields) if text_fields else Found()
    found.readings.update({f.position: Reading(f.native_kind) for f in fields if f.native_kind is not None})
    return found
