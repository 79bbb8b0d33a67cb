"""Counts, flags and one-line summaries of typed columns."""

from __future__ import annotations

import math
import re
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, numbers
from .clean import value_counts
from .columns import (
    BOOLEAN, CATEGORICAL, DATETIME, EMPTY, LABEL, NUMERIC, TEXT, UNSUPPORTED,
    Field, Profile, Reading, typed_value,
)
from .infer import long_form
from .jobs import together

# The limits behind the flags, and the names an identifier goes by.
DISCRETE_MAX_UNIQUE = 25
DISCRETE_MAX_RANGE = 100
TEXT_RULES = ((20, 0.8), (50, 0.5))
IDENTIFIER_MIN_ROWS = 10
IDENTIFIER_NAME = re.compile(r"(^|[\s_\-])(id|uuid|key|code)$|^id[\s_\-]|identifier", re.IGNORECASE)

# Longer texts are counted by their SHA-256, so that prose is not shuffled whole.
SHORT_TEXT_BYTES = 64


def exact_sum(value: Column) -> Column:
    """Sum of doubles with the whole and the fractional parts added separately.

    Whole parts add without error up to 2^53, so the result does not depend on
    the order in which partitions are merged.
    """
    whole = F.rint(value)
    return F.sum(whole) + F.sum(value - whole)


def _typed(fields: list[Field], readings: dict[int, Reading], *kinds: str) -> dict[int, Column]:
    """Typed values of the columns of the given kinds."""
    return {
        f.position: typed_value(f, readings[f.position]) for f in fields if readings[f.position].kind in kinds
    }


def number_facts(df: DataFrame, fields: list[Field], readings: dict[int, Reading]) -> dict[int, dict]:
    """Counts, extremes and moments of numbers and booleans in one scan that moves no value."""
    values = _typed(fields, readings, NUMERIC, BOOLEAN)
    if not values:
        return {}
    number = F.col("number")
    rows = long_form(df, number=values).groupBy("i").agg(
        F.count(number).alias("valid"),
        exact_sum(number).alias("sum"),
        F.stddev_samp(number).alias("std"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.count_if(number != F.rint(number)).alias("fractions"),
    )
    return {row["i"]: row.asDict() for row in rows.collect()}


def counted_values(texts: DataFrame, f: Field, reading: Reading) -> DataFrame:
    """Distinct values of a column written as text with their occurrences ``n``, each distinct text read once.

    Numbers are told apart by their decimal value ``exact``, and where it doesn't fit a decimal as doubles."""
    # the generators keep a text from being read again for every use of its value
    text = F.col("text")
    if reading.kind == DATETIME:
        moment = dates.text_timestamp(text, reading.style, reading.shapes)
        read = texts.select(F.stack(F.lit(1), moment, F.col("n")).alias("moment", "n")).where("moment is not null")
        return read.groupBy("moment").agg(F.sum("n").alias("n"))
    plain = texts.select(F.stack(F.lit(1), *numbers.plain_text(text, reading.style), F.col("n")).alias("plain", "negative", "n"))
    exact = numbers.signed_decimal(F.col("plain"), F.col("negative"))
    number = numbers.signed_number(F.col("plain"), F.col("negative"), reading.style)
    read = plain.select(F.stack(F.lit(1), exact, number, F.col("n")).alias("exact", "number", "n")).where("number is not null")
    rounded = F.when(F.col("exact").isNull(), F.col("number")).alias("rounded")
    return read.groupBy("exact", rounded).agg(F.min("number").alias("number"), F.sum("n").alias("n")).drop("rounded")


def counted_number_facts(values: DataFrame) -> tuple[dict, dict]:
    """Counts, extremes and moments of counted numbers, and the facts on their distinct values."""
    number, n, exact = F.col("number"), F.col("n"), F.col("exact")
    whole = F.rint(number)
    row = values.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("valid"),
        (F.sum(whole * n) + F.sum((number - whole) * n)).alias("sum"),
        F.min("number").alias("min"), F.max("number").alias("max"),
        F.count_if(number != whole).alias("fractions"),
        F.count("*").alias("unique"), F.count("exact").alias("fitting"),
        F.min("exact").alias("least"), F.max("exact").alias("most"), F.count_if(exact % 1 != 0).alias("parts"),
    ).first().asDict()
    facts = {name: row[name] for name in ("valid", "sum", "min", "max", "fractions")}
    names = ("unique", "fitting", "least", "most", "parts") if row["fitting"] == row["unique"] else ("unique",)
    return {**facts, **_spread(values, facts)}, {name: row[name] for name in names}


def _spread(values: DataFrame, facts: dict) -> dict:
    """Standard deviation of the sample and skewness of counted numbers; a constant has no skewness."""
    n, low, high = facts["valid"], facts["min"], facts["max"]
    if not n or low == high:
        return {"std": 0.0 if n > 1 else None, "skewness": None}
    # a sum can pass the doubles where no number does
    center = facts["sum"] / n if math.isfinite(facts["sum"]) else low / 2 + high / 2
    off = F.col("number") - F.lit(center)
    first, second, third = values.agg(*[F.sum(F.pow(off, F.lit(k)) * F.col("n")) for k in (1, 2, 3)]).first()
    shift = first / n
    squares = second - n * shift * shift
    cubes = third - 3 * shift * second + 2 * n * shift * shift * shift
    if not 0 < squares < math.inf:
        return {"std": math.sqrt(max(squares, 0.0)) / math.sqrt(n - 1) if squares == squares else math.nan, "skewness": None}
    return {"std": math.sqrt(squares / (n - 1)), "skewness": math.sqrt(n) * cubes / squares / math.sqrt(squares)}


def counted_moment_facts(values: DataFrame) -> dict:
    return values.agg(
        F.count("*").alias("unique"), F.coalesce(F.sum("n"), F.lit(0)).alias("valid"),
        F.min("moment").alias("first"), F.max("moment").alias("last"),
    ).first().asDict()


def _digest(text: Column) -> Column:
    return F.when(F.octet_length(text) > SHORT_TEXT_BYTES, F.unhex(F.sha2(text, 256)))


def _short(text: Column) -> Column:
    return F.when(F.octet_length(text) <= SHORT_TEXT_BYTES, text)


def _counted(df: DataFrame, slot: str, values: dict[int, Column], *keys: Column | str) -> DataFrame:
    """Occurrences ``n`` of every distinct value of every column, exactly, in one shuffle.

    A value that fills a third of the rows is combined to one row per task
    before the shuffle.
    """
    cells = long_form(df, **{slot: values}).where(F.col(slot).isNotNull())
    return cells.select("i", *keys).groupBy("i", *[c for c in cells.select(*keys).columns]).agg(F.count("*").alias("n"))


def _text_counts(df: DataFrame, fields: list[Field], readings: dict[int, Reading]) -> DataFrame:
    text = F.col("text")
    return _counted(
        df, "text", _typed(fields, readings, LABEL), _short(text).alias("text"), _digest(text).alias("digest")
    )


def distinct_facts(df: DataFrame, fields: list[Field], readings: dict[int, Reading]) -> dict[int, dict]:
    """Exact distinct count per column, extremes of times, and mode with its count of labels; columns whose values are
    read from text are counted apart.

    Each storage type is counted apart, over its own columns of the source.
    """
    by_kind = ((_number_distincts, (NUMERIC, BOOLEAN)), (_moment_distincts, (DATETIME,)),
               (_label_distincts, (LABEL,)), (_present, (UNSUPPORTED,)))
    jobs = []
    for count, kinds in by_kind:
        chosen = [f for f in fields if readings[f.position].kind in kinds]
        if chosen:
            jobs.append(partial(count, df, chosen, readings))
    facts: dict[int, dict] = {}
    for found in together(df.sparkSession, *jobs):
        facts.update(found)
    return facts


def _number_distincts(df: DataFrame, fields: list[Field], readings: dict[int, Reading]) -> dict[int, dict]:
    """Doubles are counted as such; whole types and decimals on keys that don't round, since doubles of 2^53 and more
    fall together."""
    numeric = [f for f in fields if readings[f.position].kind == NUMERIC]
    whole = [f for f in numeric if isinstance(f.dtype, T.LongType)]
    exact = [f for f in numeric if isinstance(f.dtype, T.DecimalType)]
    others = [f for f in fields if f not in whole and f not in exact]
    jobs = [partial(_exact_distincts, df, f, readings[f.position]) for f in exact]
    if others:
        jobs.append(partial(_double_distincts, df, others, readings))
    if whole:
        jobs.append(partial(_whole_distincts, df, whole))
    facts: dict[int, dict] = {}
    for found in together(df.sparkSession, *jobs):
        facts.update(found)
    return facts


def _double_distincts(df: DataFrame, fields: list[Field], readings: dict[int, Reading]) -> dict[int, dict]:
    counts = _counted(df, "number", _typed(fields, readings, NUMERIC, BOOLEAN), "number")
    rows = counts.groupBy("i").agg(F.count("*").alias("unique")).collect()
    return {row["i"]: {"unique": row["unique"]} for row in rows}


def _whole_distincts(df: DataFrame, fields: list[Field]) -> dict[int, dict]:
    whole = {f.position: f.raw.cast("bigint") for f in fields}
    rows = _counted(df, "whole", whole, "whole").groupBy("i").agg(
        F.count("*").alias("unique"), F.min("whole").alias("least"), F.max("whole").alias("most")).collect()
    return {row["i"]: row.asDict() for row in rows}


def _exact_distincts(df: DataFrame, f: Field, reading: Reading) -> dict[int, dict]:
    """Distinct decimals; what doesn't fit is told apart as a double."""
    values = df.where(f.raw.isNotNull()).select(F.stack(F.lit(1), f.raw, typed_value(f, reading)).alias("exact", "number"))
    key = F.when(F.col("exact").isNull(), F.col("number")).alias("rounded")
    distinct = values.where("number is not null").groupBy("exact", key).agg(F.count("*").alias("n"))
    row = distinct.agg(
        F.count("*").alias("unique"), F.count("exact").alias("fitting"), F.min("exact").alias("least"), F.max("exact").alias("most"),
        F.count_if(F.col("exact") % 1 != 0).alias("parts"),
    ).first().asDict()
    if row["fitting"] < row["unique"]:
        return {f.position: {"unique": row["unique"]}}
    return {f.position: row}


def _moment_distincts(df: DataFrame, fields: list[Field], readings: dict[int, Reading]) -> dict[int, dict]:
    rows = _counted(df, "moment", _typed(fields, readings, DATETIME), "moment").groupBy("i").agg(
        F.count("*").alias("unique"), F.sum("n").alias("valid"),
        F.min("moment").alias("first"), F.max("moment").alias("last"),
    )
    return {row["i"]: row.asDict() for row in rows.collect()}


def _label_distincts(df: DataFrame, fields: list[Field], readings: dict[int, Reading]) -> dict[int, dict]:
    is_long = F.col("digest").isNotNull()
    best_short = F.min(F.when(~is_long, F.struct((-F.col("n")).alias("n"), "text")))
    rows = _text_counts(df, fields, readings).groupBy("i").agg(
        F.count("*").alias("unique"), F.sum("n").alias("valid"),
        best_short.alias("short"), F.max(F.when(is_long, F.col("n"))).alias("long_n"),
    )
    by_position = {f.position: f for f in fields}
    return {
        row["i"]: {"unique": row["unique"], "valid": row["valid"], **_mode(df, by_position[row["i"]], readings, row)}
        for row in rows.collect()
    }


def _present(df: DataFrame, fields: list[Field], readings: dict[int, Reading]) -> dict[int, dict]:
    present = value_counts(df, fields)
    return {f.position: {"valid": present[f.physical]} for f in fields}


def _mode(df: DataFrame, f: Field, readings: dict[int, Reading], row) -> dict:
    """The most frequent label; among equals the first in text order."""
    short_n = -row["short"]["n"] if row["short"] else 0
    long_n = row["long_n"] or 0
    candidates = []
    if short_n and short_n >= long_n:
        candidates.append(row["short"]["text"])
    if long_n and long_n >= short_n:
        candidates.append(_smallest_long_text(df, f, readings, long_n))
    # Spark and Python agree on text order only by UTF-8 bytes.
    return {"mode": min(candidates, key=lambda text: text.encode()), "mode_count": max(short_n, long_n)}


def _smallest_long_text(df: DataFrame, f: Field, readings: dict[int, Reading], n: int) -> str:
    """The first in text order of the long texts that occur ``n`` times."""
    texts = df.select(f.raw.alias("text")).where(F.octet_length("text") > SHORT_TEXT_BYTES)
    if n > 1:
        tied = _text_counts(df, [f], readings).where((F.col("n") == n) & F.col("digest").isNotNull()).select("digest")
        texts = texts.withColumn("digest", _digest(F.col("text"))).join(tied, "digest", "left_semi")
    return texts.agg(F.min("text")).first()[0]


def settle(profile: Profile) -> Profile:
    """Decide kind and flags from the collected counts."""
    facts, valid, unique = profile.facts, profile.valid, profile.unique or 0
    kind = profile.reading.kind
    if not valid and kind != UNSUPPORTED:
        kind = EMPTY
    elif kind == NUMERIC:
        whole = not facts["fractions"] and not facts.get("parts")
        # extremes that are not rounded, where they are known
        span = facts["most"] - facts["least"] if facts.get("most") is not None else facts["max"] - facts["min"]
        profile.discrete = whole and unique <= DISCRETE_MAX_UNIQUE and span <= DISCRETE_MAX_RANGE
        consecutive = span == valid - 1
        profile.is_identifier = (
            whole and unique == valid >= IDENTIFIER_MIN_ROWS
            and (consecutive or bool(IDENTIFIER_NAME.search(profile.name)))
        )
    elif kind == LABEL:
        profile.is_identifier = unique == valid >= IDENTIFIER_MIN_ROWS
        mostly_unique = any(unique > least and unique / valid > share for least, share in TEXT_RULES)
        kind = TEXT if profile.is_identifier or mostly_unique else CATEGORICAL
    profile.kind = kind
    return profile
