"""Formatting of chunks: the chunk as it is, or a template over the row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, TimestampType

from vecloom import config as C


def as_text(c: Column, kind: DataType) -> Column:
    """A value as a template shows it: strings raw, null as nothing, nested values as JSON."""
    if isinstance(kind, (ArrayType, MapType, StructType)):
        c = F.to_json(c)
    elif isinstance(kind, TimestampType):
        c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return F.coalesce(c.cast("string"), F.lit(""))


def format_template(df: DataFrame, template: str, chunk: str = "chunk", fields: Iterable[str] | None = None) -> Column:
    """``template`` with $chunk, then every other column's $name in order of names, put in.

    Substitution is textual and goes on in what was put in, so a $name within a chunk is replaced too. ``fields`` limits
    the columns; where a template and all chunks name but few, that keeps the others out of the scan.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(set(kinds) - {chunk} if fields is None else set(fields) & set(kinds) - {chunk})
    out = F.replace(F.lit(template), F.lit("$chunk"), as_text(F.col(f"`{chunk}`"), kinds[chunk]))
    for name in names:
        out = F.replace(out, F.lit(f"${name}"), as_text(F.col(f"`{name}`"), kinds[name]))
    return out


def format_chunks(df: DataFrame, cfg: C.Part, chunk: str = "chunk", fields: Iterable[str] | None = None) -> DataFrame:
    """``df`` with its chunk column formatted."""
    if not isinstance(cfg, C.FormattingTemplate):
        return df
    return df.withColumn(chunk, format_template(df, cfg.template, chunk, fields))
