"""How two key columns compare: one common type, whichever way they are joined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

INTEGRAL_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
MAX_DIGITS = 38


@dataclass(frozen=True)
class Comparison:
    """SQL for the comparable form of a child's and a parent's key, and its type.

    Equal forms are equal keys, so the ledger and every join use these and
    nothing else.  The form of a null key is null, of any other it is not.
    """

    child: str
    parent: str
    kind: str


def common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type in which ``=`` compares the two; None where only texts can be."""
    if a == b:
        return a
    for one, other in ((a, b), (b, a)):
        if isinstance(one, T.StringType):
            plain = isinstance(other, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))
            return T.LongType() if type(other) in INTEGRAL_DIGITS else other if plain else None
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if type(a) in INTEGRAL_DIGITS and type(b) in INTEGRAL_DIGITS:
            return T.LongType()
        if isinstance(a, T.FractionalType) and isinstance(b, T.FractionalType):
            if not (isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType)):
                return T.DoubleType()
        elif any(isinstance(t, (T.DoubleType, T.FloatType)) for t in (a, b)):
            return T.DoubleType()
        whole = max(_whole_digits(a), _whole_digits(b))
        scale = max(getattr(a, "scale", 0), getattr(b, "scale", 0))
        # Digits of the fraction give way where not all fit, as in SQL.
        return T.DecimalType(min(MAX_DIGITS, whole + scale), max(0, min(scale, MAX_DIGITS - whole)))
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, times) and isinstance(b, times):
        zoned = any(isinstance(t, T.TimestampType) for t in (a, b))
        return T.TimestampType() if zoned else T.TimestampNTZType()
    return None


def _whole_digits(kind: T.DataType) -> int:
    if isinstance(kind, T.DecimalType):
        return kind.precision - kind.scale
    return INTEGRAL_DIGITS[type(kind)]


def comparison(child: T.DataType, child_sql: str, parent: T.DataType, parent_sql: str) -> Comparison:
    """The comparable forms of two key expressions of the given types.

    Text against another type is read as that type, so '007' is 7; text that
    cannot be read keeps a form that equals no value of the other type.
    """
    common = common_type(child, parent)
    if common is None or isinstance(common, T.BinaryType):
        kind = "string" if common is None else "binary"
        return Comparison(f"CAST({child_sql} AS {kind})", f"CAST({parent_sql} AS {kind})", kind)
    kind = common.simpleString()
    texts = [isinstance(t, T.StringType) for t in (child, parent)]
    if any(texts) and not all(texts):
        forms = [
            f"coalesce(CAST(try_cast({sql} AS {kind}) AS string), '!' || {sql})"
            if text
            else f"CAST(CAST({sql} AS {kind}) AS string)"
            for sql, text in zip((child_sql, parent_sql), texts, strict=True)
        ]
        return Comparison(*forms, "string")
    return Comparison(f"CAST({child_sql} AS {kind})", f"CAST({parent_sql} AS {kind})", kind)
