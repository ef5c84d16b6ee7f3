"""Checks of rows before they are stored, and values as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def problems(required: list[str], allowed: dict[str, list[str]] | None = None) -> Column:
    """What is wrong with a row, in the order of the columns: ``missing`` ones of the required that are null, and ``invalid``
    ones that hold none of the allowed values. An empty list for a sound row; a null breaks no list of values."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
    invalid = [F.when(~F.col(c).isin(*values), F.concat(F.lit(f"invalid {c}: "), F.col(c).cast("string"))) for c, values in (allowed or {}).items()]
    return F.array_compact(F.array(*missing, *invalid)) if missing or invalid else F.array().cast("array<string>")


def sanitised(text: Column, most: int | None = None) -> Column:
    """Text without null characters and, on request, no longer than ``most`` characters."""
    clean = F.replace(text.cast("string"), F.lit("\0"), F.lit(""))
    return clean if most is None else F.substring(clean, 1, most)


def json_safe(value: Column, kind: T.DataType) -> Column:
    """A value of a type with all its parts as JSON has them: names of maps as text; dates, times, decimals, bytes (as UTF-8) and
    other kinds as text; numbers, booleans, texts and nulls as they are."""
    if isinstance(kind, T.StructType):
        fields = [json_safe(value[f.name], f.dataType).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        named = F.transform_keys(value, lambda k, v: json_safe(k, kind.keyType).cast("string"))
        return F.transform_values(named, lambda k, v: json_safe(v, kind.valueType))
    plain = (T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType, T.StringType, T.NullType, T.VariantType)
    return value if isinstance(kind, plain) else value.cast("string")


def json_text(value: Column, kind: T.DataType) -> Column:
    """A struct, list or map of any type as JSON text; nulls are written."""
    return F.to_json(json_safe(value, kind), {"ignoreNullFields": "false"})
