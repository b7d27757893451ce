"""The four column types of the SQL surface, and what literals they take."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

from .errors import BindError

INT_MIN, INT_MAX, UINT_MAX = -(2**63), 2**63 - 1, 2**64 - 1
SPARK = {"BOOL": T.BooleanType(), "INT": T.LongType(), "UINT": T.DecimalType(20, 0), "TEXT": T.StringType()}


def kind_of(data_type: T.DataType) -> str:
    """BOOL, INT, UINT or TEXT; other Spark types (which tables may hold) by their own name."""
    if isinstance(data_type, T.BooleanType):
        return "BOOL"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INT"
    if isinstance(data_type, T.DecimalType) and data_type.scale == 0 and data_type.precision == 20:
        return "UINT"
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return "TEXT"
    return data_type.simpleString()


def literal_kind(value: object) -> str:
    if value is None:
        return "NULL"
    return "BOOL" if isinstance(value, bool) else "INT" if isinstance(value, int) else "TEXT"


#: What Spark's own numeric and time columns take besides: literals that convert without loss.
LAX = {"double": "INT", "float": "INT", "timestamp": "TEXT", "timestamp_ntz": "TEXT", "date": "TEXT"}


def coerce(value: object, kind: str, what: str = "value") -> object:
    """The literal as a value of a column's type.  Whole numbers fit INT or UINT columns in range; nothing else
    changes its type."""
    given = literal_kind(value)
    if given == "NULL":
        return None
    if given == "INT" and kind == "INT":
        if not INT_MIN <= value <= INT_MAX:
            raise BindError(f"{value} is out of range for INT {what}")
        return value
    if given == "INT" and kind == "UINT":
        if not 0 <= value <= UINT_MAX:
            raise BindError(f"{value} is out of range for UINT {what}")
        return Decimal(value)
    if given == kind or LAX.get(kind) == given or kind.startswith("decimal") and given == "INT":
        return value
    raise BindError(f"{what} is {kind}; a {given} literal does not fit")
