"""Report tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.rounding import finite_or_null

FORMATS = ("parquet", "json", "csv")


@dataclass
class Report:
    """The tables of a report by name: codebook, descriptives, frequencies, comparison."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def save(self, path: str, format: str = "parquet", mode: str = "error") -> None:
        """Write each table to its own folder under ``path``; no NaN or infinity is written."""
        if format not in FORMATS:
            raise ValueError(f"format must be one of: {', '.join(FORMATS)}.")
        for name, table in self.tables.items():
            writer = finite_or_null(table).write.mode(mode)
            if format == "csv":
                writer = writer.option("header", True)
            writer.format(format).save(f"{path.rstrip('/')}/{name}")


def report(ds, column: str | None = None, comparison: dict | None = None, top: int | None = 25, bins: int | None = None,
           order: str = "count", slices: bool = False, overall: bool = False) -> Report:
    """Codebook, one variable and one comparison; what is not given is suggested.

    ``top``, ``bins`` and ``order`` ("count" or "label") shape the variable's frequencies. ``slices`` adds its shares for a
    pie, ``overall`` the comparison's figure for all rows with the number of groups and whether some were cut off."""
    if column is None or comparison is None:
        first = ds.suggest()
        column = column or first.variable
        if comparison is None and first.group_by:
            comparison = {"group_by": first.group_by, "metric": first.metric, "agg": first.agg}
    tables = {"codebook": ds.codebook()}
    if column:
        tables["descriptives"] = ds.descriptive_table(column)
        shown = ds.distribution(column, top, bins)
        tables["frequencies"] = shown.frequency_table(order)
        if slices:
            tables["slices"] = shown.slices(order=order)
    if comparison:
        compared = ds.compare(**comparison)
        tables["comparison"] = compared.items
        if overall:
            tables["overall"] = compared.overall
    return Report(tables)
