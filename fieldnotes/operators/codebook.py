"""The codebook and the dataset's own facts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .columns import BOOLEAN, CATEGORICAL, DATETIME, NUMERIC, TEXT, Profile

CODEBOOK_SCHEMA = (
    "position int, name string, kind string, discrete boolean, is_identifier boolean, "
    "valid bigint, missing bigint, missing_pct double, unique bigint, "
    "mean double, std double, min double, max double, mode string, mode_pct double, "
    "true_pct double, first timestamp_ntz, last timestamp_ntz"
)


def _summary(p: Profile) -> dict:
    facts, valid = p.facts, p.valid
    if not valid:
        return {}
    if p.kind == NUMERIC:
        return {"mean": facts["sum"] / valid, "std": facts["std"], "min": facts["min"], "max": facts["max"]}
    if p.kind in (CATEGORICAL, TEXT):
        return {"mode": facts["mode"], "mode_pct": facts["mode_count"] / valid * 100}
    if p.kind == BOOLEAN:
        return {"true_pct": facts["sum"] / valid * 100}
    if p.kind == DATETIME:
        return {"first": facts["first"], "last": facts["last"]}
    return {}


_DIGITS = {"mean": 4, "std": 4, "min": 4, "max": 4, "mode_pct": 1, "true_pct": 1}


def codebook(ds) -> DataFrame:
    """One row per column: kind, flags, counts and a one-line summary."""
    lines = []
    for p in ds.profiles():
        summary = {k: round(v, _DIGITS[k]) if k in _DIGITS and v is not None else v for k, v in _summary(p).items()}
        lines.append((
            p.field.position + 1, p.name, p.kind, p.discrete, p.is_identifier, p.valid, p.missing,
            round(p.missing_pct, 2), p.unique,
            *[summary.get(k) for k in ("mean", "std", "min", "max", "mode", "mode_pct", "true_pct", "first", "last")],
        ))
    return ds.spark.createDataFrame(lines, CODEBOOK_SCHEMA)


def dataset_meta(ds) -> DataFrame:
    """One row about the table as a whole."""
    return ds.spark.createDataFrame(
        [(ds.name, ds.row_count, len(ds.fields), list(ds.tables), ds.table)],
        "name string, rows bigint, column_count int, tables array<string>, active_table string",
    )
