"""Type predicates and display labels over Spark `DataType`s."""

from __future__ import annotations

from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, _INTEGRAL)


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, _FRACTIONAL)


def is_number(dt: T.DataType) -> bool:
    """Numeric values that statistics (mean, median, interpolation) apply to."""
    return isinstance(dt, _INTEGRAL + _FRACTIONAL + (T.DecimalType,))


def is_numeric_like(dt: T.DataType) -> bool:
    """The wider 'numeric' gate of the detectors, which counts booleans too."""
    return is_number(dt) or isinstance(dt, T.BooleanType)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.CharType, T.VarcharType))


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_atomic(dt: T.DataType) -> bool:
    """Types profiled value by value; arrays, maps, structs pass through."""
    return not isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType,
                               T.VariantType))


def friendly_type(dt: T.DataType) -> str:
    if is_integral(dt):
        return "Integer"
    if is_floating(dt) or isinstance(dt, T.DecimalType):
        return "Float"
    if isinstance(dt, T.BooleanType):
        return "Boolean"
    if is_datetime(dt):
        return "Datetime"
    if is_string(dt):
        return "Text / Categorical"
    return dt.simpleString().capitalize()


def fixed_width(dt: T.DataType) -> int:
    """Bytes per value for the memory estimate (strings are measured instead)."""
    widths = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4,
              T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8,
              T.TimestampType: 8, T.TimestampNTZType: 8}
    if isinstance(dt, T.DecimalType):
        return 8 if dt.precision <= 18 else 16
    return widths.get(type(dt), 8)
