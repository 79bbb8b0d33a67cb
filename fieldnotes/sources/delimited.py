"""Delimited text files as one table."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..operators.clean import FILLER_PREFIX, clean_headers, has_value
from ..session import shared_folder
from . import records
from .scan import UTF8, decoded, parse_header, read_lines, survey


class NoRows(ValueError):
    """A delimited table without any row of data."""


@dataclass(frozen=True)
class _Layout:
    """A delimiter and a header, shared by all files that are written so."""

    sep: str
    header: tuple[str, ...]


def reader_headers(header: list[str]) -> list[str]:
    """Names as a reader of delimited files gives them: blanks by place, repeats with ``.1``, ``.2``."""
    names: list[str] = []
    repeats: dict[str, int] = {}
    for place, name in enumerate(header):
        name = name or f"{FILLER_PREFIX}{place}"
        unique = name
        while unique in names:
            repeats[name] = repeats.get(name, 0) + 1
            unique = f"{name}.{repeats[name]}"
        names.append(unique)
    return names


def _stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/fieldnotes-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _layouts(files: DataFrame, path: str) -> tuple[dict[tuple, int], list[_Layout]]:
    """The number of the layout of every (sep, encoding, header) that occurs, and the layouts.

    The driver sees one row for each way of being written, however many files are written so."""
    written = files.groupBy("sep", "encoding", "header_bytes").agg(F.min("path").alias("example")).collect()
    layouts: dict[_Layout, int] = {}
    numbers = {}
    for row in written:
        raw = bytes(row["header_bytes"])
        header = parse_header(raw.decode("utf-8-sig" if row["encoding"] == UTF8 else row["encoding"]), row["sep"])
        if not header:
            raise NoRows(f"{row['example']} is empty.")
        layout = _Layout(row["sep"], tuple(clean_headers(reader_headers(header))))
        numbers[row["sep"], row["encoding"], raw] = layouts.setdefault(layout, len(layouts))
    if not layouts:
        raise NoRows(f"{path} holds no delimited file, or only empty ones.")
    return numbers, list(layouts)


def _numbered(files: DataFrame, numbers: dict[tuple, int]) -> DataFrame:
    """Files with the number of their layout."""
    spark = files.sparkSession
    known = spark.createDataFrame([(s, e, bytearray(h), n) for (s, e, h), n in numbers.items()], "sep string, encoding string, header_bytes binary, layout int")
    return files.join(known, ["sep", "encoding", "header_bytes"])


def _read_records(spark: SparkSession, path: str, sep: str | None) -> tuple[DataFrame, list[_Layout]]:
    """(file, layout, record, fields) of every record behind the headers, and the layouts."""
    files, splits = survey(spark, path, sep, _stored)
    files = _stored(files)
    numbers, layouts = _layouts(files, path)
    files = _numbered(files, numbers).select("file", "sep", "encoding", "layout", "multiline", "header_line")
    few = files.count() <= records.FEW_SPLITS
    # lines that are records, without those of files in which cells hold line breaks
    lines = read_lines(spark, path)
    known = F.broadcast(files) if few else files
    parts = []
    if not files.where("NOT multiline").isEmpty():
        own = lines.join(known, "file").where("NOT multiline AND line <> header_line")
        parts.append(own.select("file", "layout", "encoding", F.col("text").alias("raw")))
    long_files = files.where("multiline")
    if not long_files.isEmpty():
        whole = records.assembled(lines, splits, long_files, _stored)
        filled = F.btrim("text", F.lit(" \t\n\x0b\f\r")) != ""
        heads = whole.where(filled).groupBy("file").agg(F.min(F.struct("block", "place")).alias("head"))
        body = whole.join(F.broadcast(heads) if few else heads, "file").where(F.struct("block", "place") != F.col("head"))
        body = body.join(known, "file").orderBy("file", "block", "place")
        parts.append(body.select("file", "layout", "encoding", F.col("text").alias("raw")))
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return whole.select("file", "layout", decoded(F.col("raw"), F.col("encoding")).alias("record")), layouts


def _read_all(spark: SparkSession, path: str, sep: str | None) -> tuple[DataFrame, list[str]]:
    """Every record under ``path``: its cells as text under ``n0``, ``n1`` …, matched by name over layouts, the file, the
    record, its number of fields and the number that its header has."""
    found, layouts = _read_records(spark, path, sep)
    names = list(dict.fromkeys(name for layout in layouts for name in layout.header))
    read, fields, expected = [], F.lit(0), F.lit(0)
    for k, layout in enumerate(layouts):
        here = F.col("layout") == k
        options = dict(sep=layout.sep, quote='"', escape='"', ignoreLeadingWhiteSpace="true", maxColumns=str(len(layout.header) + 20480))
        # one column more, for the first field without a name
        schema = ", ".join(f"f{i} string" for i in range(len(layout.header) + 1))
        read.append(F.when(here, F.from_csv("record", schema, options)).alias(f"p{k}"))
        fields = F.when(here, records.field_count(F.col("record"), layout.sep)).otherwise(fields)
        expected = F.when(here, len(layout.header)).otherwise(expected)
    # the generator keeps a record from being parsed again for every use of a cell
    rows = found.select("file", "record", F.explode(F.array(F.struct(*read, "layout", fields.alias("fields"), expected.alias("expected")))).alias("p"))
    cells = []
    for i, name in enumerate(names):
        places = [F.col(f"p.p{k}.f{layout.header.index(name)}") for k, layout in enumerate(layouts) if name in layout.header]
        cells.append(F.coalesce(*places).alias(f"n{i}"))
    over = F.coalesce(*[F.col(f"p.p{k}.f{len(layout.header)}") for k, layout in enumerate(layouts)])
    return rows.select(*cells, "file", "record", "p.fields", "p.expected", over.alias("over")), names


def read_delimited(spark: SparkSession, path: str, on_bad: str = "fail", name: str | None = None,
                   stage: bool = True, sep: str | None = None) -> Dataset:
    """A dataset from a delimited file or a folder of them.

    Delimiter, encoding and line breaks inside cells are found out per file from all lines; ``sep`` settles the
    delimiter. Files are split wherever Spark splits them, also inside a cell with line breaks.
    Rows with more fields than the header fail the job that meets them, or are
    left out with ``on_bad="quarantine"`` (``bad_rows`` shows them). The cells are
    parsed once and kept as Parquet in the shared folder, unless ``stage`` is off.
    """
    if on_bad not in ("fail", "quarantine"):
        raise ValueError("on_bad must be 'fail' or 'quarantine'.")
    df, names = _read_all(spark, path, sep)
    fits = F.col("fields") <= F.col("expected")
    if on_bad == "fail":
        told = F.concat(F.lit("A row has more fields than the header: "), F.substring("record", 1, 200), F.lit(" (in "), "file", F.lit(")"))
        fits = fits | F.raise_error(told).cast("boolean")
    cells = df.where(fits).select(*[f"n{k}" for k in range(len(names))])
    ds = Dataset(cells, names, name=name or path.rstrip("/").rsplit("/", 1)[-1], delimited=True)
    if ds.fields and stage:
        ds.stage()
    if not ds.fields or (ds.row_count == 0 if stage else ds.cells.where(has_value(ds.fields)).isEmpty()):
        raise NoRows(f"{path} has no data behind its header.")
    return ds


def bad_rows(spark: SparkSession, path: str, sep: str | None = None, whole: bool = False) -> DataFrame:
    """Rows with more fields than their header, with the file they come from and the first field without a name.

    With ``whole`` also the row as it is written, its number of fields and the number its header has."""
    df, names = _read_all(spark, path, sep)
    bad = df.where(F.col("fields") > F.col("expected"))
    more = [F.col("record"), F.col("fields"), F.col("expected").alias("header_fields")] if whole else []
    cells = [F.col(f"n{k}") for k in range(len(names))]
    return bad.select("file", *cells, "over", *more).toDF("file", *names, "first_extra_field", *(["record", "fields", "header_fields"] if whole else []))
