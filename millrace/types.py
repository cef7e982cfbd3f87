"""Type names, type groups and common supertypes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import types as T

# User-facing type names and the Spark types that stand for them. Spark has no
# unsigned integers (next wider signed type is used) and no time of day (text HH:mm:ss).
NAMED_TYPES: dict[str, T.DataType] = {
    "Int8": T.ByteType(),
    "Int16": T.ShortType(),
    "Int32": T.IntegerType(),
    "Int64": T.LongType(),
    "UInt8": T.ShortType(),
    "UInt16": T.IntegerType(),
    "UInt32": T.LongType(),
    "UInt64": T.DecimalType(20, 0),
    "Float32": T.FloatType(),
    "Float64": T.DoubleType(),
    "Decimal": T.DecimalType(38, 9),
    "String": T.StringType(),
    "Categorical": T.StringType(),
    "Date": T.DateType(),
    "Datetime": T.TimestampType(),
    "Time": T.StringType(),
    "Duration": T.DayTimeIntervalType(),
    "Boolean": T.BooleanType(),
    "Binary": T.BinaryType(),
}

# Accepted spellings per type name.
ALIASES: dict[str, tuple[str, ...]] = {
    "Int8": ("i8",),
    "Int16": ("i16",),
    "Int32": ("i32", "int32"),
    "Int64": ("i64", "int64", "int", "integer", "bigint"),
    "UInt8": ("u8",),
    "UInt16": ("u16",),
    "UInt32": ("u32", "uint32"),
    "UInt64": ("u64", "uint64"),
    "Float32": ("f32", "float32"),
    "Float64": ("f64", "float64", "float", "double"),
    "Decimal": ("decimal", "dec"),
    "String": ("str", "string", "utf8", "varchar", "text"),
    "Categorical": ("cat", "categorical", "enum", "factor"),
    "Date": ("date",),
    "Datetime": ("datetime", "timestamp"),
    "Time": ("time",),
    "Duration": ("duration", "timedelta"),
    "Boolean": ("bool", "boolean"),
    "Binary": ("binary", "bytes", "bytea"),
    "List": ("list", "array"),
    "Struct": ("struct", "object"),
    "Array": ("fixed_array",),
}

_SPELLINGS = {s: name for name, others in ALIASES.items() for s in (name.lower(), *others)}

GROUPS = ("Numeric", "String", "Date", "Boolean", "Binary", "Complex")

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_INTEGRAL_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
_COMPLEX = (T.ArrayType, T.StructType, T.MapType)


def type_named(spec: str | T.DataType) -> T.DataType:
    """Spark type for a type name, an alias, or any Spark DDL type; an unknown name is text."""
    if isinstance(spec, T.DataType):
        return spec
    name = _SPELLINGS.get(spec.strip().lower())
    if name in NAMED_TYPES:
        return NAMED_TYPES[name]
    try:
        return T.DataType.fromDDL(spec)
    except Exception:
        return T.StringType()


def group_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "Numeric"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "String"
    if isinstance(dtype, (*_TEMPORAL, T.DayTimeIntervalType)):
        return "Date"
    if isinstance(dtype, T.BooleanType):
        return "Boolean"
    if isinstance(dtype, T.BinaryType):
        return "Binary"
    return "Complex"


def matches(dtype: T.DataType, spec: str | T.DataType) -> bool:
    """True when a column of `dtype` belongs to a group, a type name, an alias, or ``ALL``."""
    if isinstance(spec, T.DataType):
        return dtype == spec
    text = spec.strip().lower()
    if text == "all":
        return True
    by_group = {g.lower(): g for g in GROUPS}
    if text in by_group:
        return group_of(dtype) == by_group[text]
    name = _SPELLINGS.get(text)
    if name in ("List", "Array"):
        return isinstance(dtype, T.ArrayType)
    if name == "Struct":
        return isinstance(dtype, T.StructType)
    if name == "Decimal":
        return isinstance(dtype, T.DecimalType)
    if name == "Datetime":
        return isinstance(dtype, (T.TimestampType, T.TimestampNTZType))
    if name is None:
        raise ValueError(f"Unknown type or type group: {spec}")
    return dtype == NAMED_TYPES[name]


def _as_decimal(dtype: T.DataType) -> T.DecimalType:
    if isinstance(dtype, T.DecimalType):
        return dtype
    return T.DecimalType(_INTEGRAL_DIGITS.get(type(dtype), 1), 0)


def _numeric_supertype(a: T.DataType, b: T.DataType) -> T.DataType:
    kinds = (type(a), type(b))
    if T.DoubleType in kinds:
        return T.DoubleType()
    if T.FloatType in kinds:
        other = b if isinstance(a, T.FloatType) else a
        narrow = isinstance(other, (T.FloatType, T.BooleanType, T.ByteType, T.ShortType))
        return T.FloatType() if narrow else T.DoubleType()
    if T.DecimalType in kinds:
        x, y = _as_decimal(a), _as_decimal(b)
        scale = max(x.scale, y.scale)
        whole = max(x.precision - x.scale, y.precision - y.scale)
        return T.DecimalType(38, scale) if whole + scale > 38 else T.DecimalType(whole + scale, scale)
    order = (T.BooleanType, *_INTEGRAL)
    return a if order.index(type(a)) >= order.index(type(b)) else b


def supertype(a: T.DataType, b: T.DataType) -> T.DataType:
    """Smallest type both sides can be cast to without failing at run time.

    Numbers widen (boolean, byte, short, int, long, decimal, float, double), a date widens to a
    timestamp, and any other pair of plain values meets as text.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    countable = (T.NumericType, T.BooleanType)
    if isinstance(a, countable) and isinstance(b, countable):
        return _numeric_supertype(a, b)
    if isinstance(a, _TEMPORAL) and isinstance(b, _TEMPORAL):
        zoned = T.TimestampType() in (a, b)
        return T.TimestampType() if zoned else T.TimestampNTZType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(supertype(a.elementType, b.elementType), True)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and a.names == b.names:
        return T.StructType(
            [T.StructField(x.name, supertype(x.dataType, y.dataType), True) for x, y in zip(a, b)]
        )
    unprintable = (*_COMPLEX, T.BinaryType)
    if isinstance(a, unprintable) or isinstance(b, unprintable):
        raise TypeError(f"No common type for {a.simpleString()} and {b.simpleString()}")
    return T.StringType()


def common_type(dtypes: Iterable[T.DataType]) -> T.DataType:
    return reduce(supertype, dtypes, T.NullType())
