"""What is known about one column."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, flags, numbers
from ..functions.rounding import finite

NUMERIC, BOOLEAN, DATETIME = "numeric", "boolean", "datetime"
CATEGORICAL, TEXT, EMPTY, UNSUPPORTED = "categorical", "text", "empty", "unsupported"
# A text column that is neither number, date nor yes/no; its distinct count
# decides between categorical and text.
LABEL = "label"

_NUMBER_TYPES = (T.NumericType,)
_TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


@dataclass
class Field:
    """A source column: its display name and its physical column in the frame."""

    position: int
    name: str
    physical: str
    dtype: T.DataType

    @property
    def raw(self) -> Column:
        return F.col(self.physical)

    @property
    def native_kind(self) -> str | None:
        """The kind a storage type settles by itself; None for text."""
        if isinstance(self.dtype, _NUMBER_TYPES):
            return NUMERIC
        if isinstance(self.dtype, T.BooleanType):
            return BOOLEAN
        if isinstance(self.dtype, _TIME_TYPES):
            return DATETIME
        if isinstance(self.dtype, T.NullType):
            return EMPTY
        if isinstance(self.dtype, (T.StringType, T.CharType, T.VarcharType)):
            return None
        return UNSUPPORTED


@dataclass
class Reading:
    """How the raw cells of a field become typed values."""

    kind: str
    style: str = ""
    shapes: tuple[str, ...] = ()
    # The type a reader of delimited files would give the raw cells: "" for text.
    cell_type: str = ""


@dataclass
class Profile:
    """Everything the codebook says about a field."""

    field: Field
    reading: Reading
    kind: str
    rows: int
    valid: int
    unique: int | None = None
    discrete: bool = False
    is_identifier: bool = False
    facts: dict[str, Any] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.field.name

    @property
    def missing(self) -> int:
        return self.rows - self.valid

    @property
    def missing_pct(self) -> float:
        return self.missing / self.rows * 100 if self.rows else 0.0


def typed_value(f: Field, reading: Reading) -> Column:
    """The typed view of a field: double, boolean, UTC wall time or text."""
    raw, native = f.raw, f.native_kind
    if reading.kind == NUMERIC:
        return numbers.styled_number(raw, reading.style) if native is None else finite(raw)
    if reading.kind == BOOLEAN:
        return F.when(raw.isNotNull(), flags.is_true_word(raw)) if native is None else raw
    if reading.kind == DATETIME:
        if native is None:
            return dates.text_timestamp(raw, reading.style, reading.shapes)
        if isinstance(f.dtype, T.TimestampType):
            return F.convert_timezone(None, F.lit("UTC"), raw.cast("timestamp_ntz"))
        return raw.cast("timestamp_ntz")
    if reading.kind == EMPTY:
        return F.lit(None).cast("string")
    return raw


def is_parsed(f: Field, reading: Reading) -> bool:
    """Whether the typed values are read from text, which costs more than copying them."""
    return f.native_kind is None and reading.kind in (NUMERIC, DATETIME)


def shown_cell(f: Field, reading: Reading | None) -> tuple[Column, T.DataType]:
    """The raw cell as a row page shows it; cells of delimited files get their reader's type."""
    cell_type = reading.cell_type if reading else ""
    if cell_type == "bigint":
        return f.raw.try_cast("bigint"), T.LongType()
    if cell_type == "double":
        return F.coalesce(numbers.plain_number(f.raw), numbers.infinity(f.raw)), T.DoubleType()
    if cell_type == "boolean":
        return f.raw.try_cast("boolean"), T.BooleanType()
    return f.raw, f.dtype
