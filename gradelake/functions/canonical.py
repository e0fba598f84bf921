"""Canonical JSON as Column expressions, compiled from a type: keys sorted at every depth, no spaces, null fields kept, and texts escaped as the driver's own
``scalars.canonical_json`` escapes them, byte for byte.

Texts, integers, booleans, arrays, structs and maps with text keys have a canonical form. Fractions have none (their shortest digits differ between
machines' libraries), nor have times; a type with one is an error when the expression is made, never a silent difference in a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The short escapes of JSON; other characters below U+0020 are written as four lower-case hex digits.
SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}
ESCAPES = SHORT | {chr(i): f"\\u{i:04x}" for i in range(0x20) if chr(i) not in SHORT}


def quoted(text: Column) -> Column:
    """A text in quotes. Most texts hold nothing to escape and are taken as they are."""
    escaped = text
    for char, told in ESCAPES.items():  # the backslash first
        escaped = F.replace(escaped, F.lit(char), F.lit(told))
    body = F.when(text.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(text)
    return F.concat(F.lit('"'), body, F.lit('"'))


def encoded(value: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a column of a type; null is ``null``."""
    if isinstance(kind, T.StringType):
        text = quoted(value)
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        text = value.cast("string")
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    elif isinstance(kind, T.ArrayType):
        parts = F.transform(value, lambda x: encoded(x, kind.elementType))
        text = F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        if len({f.name for f in fields}) < len(fields):
            raise ValueError("a field's name is repeated")
        pairs = [F.concat(quoted(F.lit(f.name)), F.lit(":"), encoded(value.getField(f.name), f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        parts = F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), encoded(e["value"], kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical form")
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def row_json(df: DataFrame, columns: list[str]) -> Column:
    """The canonical JSON object of some of a table's columns."""
    pairs = [F.concat(quoted(F.lit(c)), F.lit(":"), encoded(F.col(f"`{c}`"), df.schema[c].dataType)) for c in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def object_json(**fields: tuple[Column, str]) -> Column:
    """The canonical JSON object of named columns, each with its type's name (string or long)."""
    kinds = {"string": T.StringType(), "long": T.LongType()}
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(quoted(F.lit(n)), F.lit(":"), encoded(*((c, kinds[k])))) for n, (c, k) in sorted(fields.items())]), F.lit("}"))
