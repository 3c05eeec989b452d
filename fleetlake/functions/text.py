"""Escaping, redaction and number rules, as column expressions.

Dump fields are handled byte by byte, so that blobs survive; where a pattern is needed they
are read as ISO-8859-1, one character per byte.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ONE_BYTE = "ISO-8859-1"
NULL_FIELD = r"\N"


def null_escape(text: Column) -> Column:
    """Turn an escaped ``0`` (odd run of backslashes before it) into the byte 0x00."""
    return F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\0", "$1\u0000")


def escape_field(value: Column, data_type: T.DataType) -> Column:
    """One dump field: escapes added, null as ``\\N``. Works on bytes, whatever they encode."""
    if isinstance(data_type, T.BooleanType):
        text = value.cast("int").cast("string")
    else:
        text = value.cast("string")
    if isinstance(data_type, (T.BinaryType, T.StringType)):
        for plain, escaped in (("\\", "\\\\"), ("\t", "\\\t"), ("\n", "\\\n"), ("\0", "\\0")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.coalesce(text, F.lit(NULL_FIELD))


def dump_line(df: DataFrame) -> Column:
    """All columns of a row as one dump record."""
    return F.concat_ws("\t", *[escape_field(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])


def typed_field(field: Column, data_type: T.DataType) -> Column:
    """The bytes of one field as a value of ``data_type``."""
    if isinstance(data_type, T.BinaryType):
        return field
    text = field.cast("string")
    if isinstance(data_type, T.BooleanType):
        return text.cast("int").cast("boolean")
    return text.cast(data_type)


def redact_columns(df: DataFrame, columns: Sequence[str] = ("passwd", "user")) -> DataFrame:
    """Replace the values of the given columns, where present."""
    return df.withColumns({c: F.lit("REDACTED") for c in columns if c in df.columns})


def redact_text(text: Column, secret: Column) -> Column:
    """Replace every occurrence of a secret in a stored command."""
    return F.when(F.length(secret) > 0, F.replace(text, secret, F.lit("REDACTED"))).otherwise(text)


def redact_pattern(text: Column, pattern: str) -> Column:
    """Replace every match of a pattern."""
    return F.regexp_replace(text, pattern, "REDACTED")


def normalize_ddl(ddl: Column) -> Column:
    """Drop the table's next auto-increment value, which differs on every server."""
    return F.regexp_replace(ddl, r"AUTO_INCREMENT=[0-9]+ ", "")


def whole_mb(size_bytes: Column) -> Column:
    """Whole MB, rounded down."""
    return F.call_function("div", size_bytes, F.lit(1048576))
