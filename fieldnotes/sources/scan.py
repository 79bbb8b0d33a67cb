"""How delimited files are written, found out by Spark from all of their lines.

Lines are read as text, so that files are split whatever their cells hold. One scan counts, per split, how often every
candidate delimiter stands outside quotes on a line; a file's delimiter is the one whose count is the same on most lines.
"""

from __future__ import annotations

import csv
import io
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records

# The files that are read, and what is tried on them.
EXTENSIONS = (".csv", ".tsv", ".txt")
DELIMITERS = ",;\t|"
UTF8, CP1252, LATIN1 = "utf-8", "cp1252", "latin-1"
# Bytes without a character in Windows-1252.
CP1252_GAPS = "[\u0081\u008d\u008f\u0090\u009d]"

_SUFFIX = r"(?i)\.(" + "|".join(e[1:] for e in EXTENSIONS) + ")$"
_BLANKS = " \t\n\x0b\f\r"


def parse_header(text: str, sep: str) -> list[str]:
    """Field names of the first non-blank record."""
    rows = csv.reader(io.StringIO(text), delimiter=sep, skipinitialspace=True)
    return next((row for row in rows if any(cell.strip() for cell in row)), [])


def open_location(path: str):
    """File system and path of a Hadoop-style location."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = path.rpartition("://") if "://" in path else path.rpartition(":/")
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    # Spark shows paths as they are; a URI has its spaces and accents escaped.
    return fs.FileSystem.from_uri(f"{re.sub('^s3[an]$', 's3', scheme)}://{quote(rest)}")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes; the contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.where(F.col("path").rlike(_SUFFIX)).select(
        "path", F.col("_metadata.file_path").alias("file"), "length"
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the delimited files under ``path``, with their split and an id that grows in it."""
    of = {"file": "file_path", "block": "file_block_start", "size": "file_block_length"}
    # A test on the path alone is made on the list of files, so others are not opened.
    texts = spark.read.option("recursiveFileLookup", "true").text(path).where(F.col("_metadata.file_path").rlike(_SUFFIX))
    split = [F.col(f"_metadata.{column}").alias(name) for name, column in of.items()]
    return texts.select(*split, F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))


def _line_facts(lines: DataFrame, candidates: str) -> DataFrame:
    """Per split and way of being written: how many lines, the first of them that is not blank, which encodings fit,
    and behind which delimiters a line leaves a cell open."""
    text = F.col("text")
    quoted = text.contains('"')
    bare = F.when(quoted, F.regexp_replace(text, '"[^"]*+(?:"|$)', "")).otherwise(text)
    counts = {f"count{k}": records.occurrences(F.col("bare"), c) for k, c in enumerate(candidates)}
    filled = F.btrim(text, F.lit(_BLANKS)) != ""
    opened = [
        F.when(quoted & records.ends_inside(text, c), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(candidates)
    ]
    keys = ("file", "block", "size", *counts)
    seen = lines.withColumn("bare", bare).select(
        "file", "block", "size", "line", "text", *[c.alias(name) for name, c in counts.items()],
        filled.alias("filled"), reduce(lambda a, b: a.bitwiseOR(b), opened).alias("opened"),
    )
    as_latin = F.decode(text.cast("binary"), "ISO-8859-1")
    return seen.groupBy(*keys).agg(
        F.count_if("filled").alias("n"),
        F.min(F.when(F.col("filled"), F.struct("line", text.cast("binary").alias("text"), "opened"))).alias("first"),
        F.bool_and(F.is_valid_utf8("text")).alias("utf8"),
        F.bool_and(~as_latin.rlike(CP1252_GAPS)).alias("cp1252"),
        F.bit_or("opened").alias("opened"),
    )


def _delimiters(facts: DataFrame, candidates: str) -> DataFrame:
    """Per file the candidate whose number on a line, other than none, is the same on most lines; of equals the one with
    the larger number, then the first of the candidates."""
    counted = F.explode(F.array(*[F.struct(F.lit(-k).alias("place"), F.col(f"count{k}").alias("count")) for k in range(len(candidates))]))
    numbers = facts.select("file", "n", counted.alias("c")).where("c.count > 0 and n > 0")
    alike = numbers.groupBy("file", "c.place", "c.count").agg(F.sum("n").alias("lines"))
    return alike.groupBy("file").agg((-F.max(F.struct("lines", "count", "place"))["place"]).alias("place"))


def _from_cp1252(cell: Column) -> Column:
    """Characters of bytes 0x80 to 0x9F, which Latin-1 leaves as control characters."""
    pairs = [(chr(b), bytes([b]).decode(CP1252, errors="ignore")) for b in range(0x80, 0xA0)]
    known = [(raw, char) for raw, char in pairs if char]
    return F.translate(cell, "".join(raw for raw, _ in known), "".join(char for _, char in known))


def decoded(raw: Column, encoding: Column) -> Column:
    """The text of a line's bytes; a byte order mark is left out."""
    latin = F.decode(raw.cast("binary"), "ISO-8859-1")
    utf8 = raw.cast("string")
    utf8 = F.when(utf8.startswith("﻿"), F.substring(utf8, 2, 1 << 30)).otherwise(utf8)
    return F.when(encoding == UTF8, utf8).when(encoding == CP1252, _from_cp1252(latin)).otherwise(latin)


def survey(spark: SparkSession, path: str, sep: str | None = None, store=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(files, splits): per file how it is written and its first record, per split where its first line stands.

    ``store`` keeps what the one scan over all lines has counted."""
    candidates = DELIMITERS + (sep if sep and sep not in DELIMITERS else "")
    lines = read_lines(spark, path)
    facts = store(_line_facts(lines, candidates))
    written = facts.groupBy("file").agg(
        F.min(F.when(F.col("first").isNotNull(), F.struct("block", "first"))).alias("head"),
        F.bool_and("utf8").alias("utf8"), F.bool_and("cp1252").alias("cp1252"), F.bit_or("opened").alias("opened"),
    )
    forced = F.when(F.col("path").rlike(r"(?i)\.tsv$"), DELIMITERS.index("\t"))
    place = F.lit(candidates.index(sep)) if sep else F.coalesce(forced, F.col("place"), F.lit(0))
    encoding = F.when(F.coalesce("utf8", F.lit(True)), UTF8).when(F.col("cp1252"), CP1252).otherwise(LATIN1)
    files = list_files(spark, path).join(written, "file", "left").join(_delimiters(facts, candidates), "file", "left")
    files = files.withColumn("place", place)
    opens = lambda bits: F.coalesce(F.call_function("shiftright", bits, F.col("place")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    files = files.select(
        "file", "path", F.col("length").alias("bytes"), F.get(F.array(*map(F.lit, candidates)), F.col("place")).alias("sep"),
        encoding.alias("encoding"), opens(F.col("opened")).alias("multiline"),
        F.coalesce(F.col("head.first.text"), F.lit(b"")).alias("header_bytes"), F.col("head.first.line").alias("header_line"),
        opens(F.col("head.first.opened")).alias("header_opens"),
    )
    splits = facts.select("file", "block", "size").distinct()
    long_heads = files.where("header_opens")
    if not long_heads.isEmpty():  # a name of a column holds a line break
        whole = records.assembled(lines, splits, long_heads, store)
        first = whole.where(F.btrim("text", F.lit(_BLANKS)) != "").groupBy("file").agg(
            F.min(F.struct("block", "place", F.col("text").cast("binary").alias("text")))["text"].alias("whole_header"))
        files = files.join(first, "file", "left").withColumn("header_bytes", F.coalesce("whole_header", "header_bytes")).drop("whole_header")
    return files, splits


def scan_files(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Path, size, delimiter, encoding and first record of every delimited file under ``path``, and whether cells of it
    hold line breaks. ``sep`` settles the delimiter."""
    files, _ = survey(spark, path, sep)
    return files.select("path", "bytes", "sep", "encoding", "multiline", "header_bytes")
