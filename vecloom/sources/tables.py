"""Sources: anything Spark reads, with the key columns that Spark doesn't know of."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vecloom import config as C
from vecloom.operators.chunking import is_blank


@dataclass(frozen=True)
class Source:
    """``name`` is a table of the session's catalog, or a path if ``format`` is given."""

    name: str
    pk: tuple[str, ...]
    format: str | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format(self.format).load(self.name) if self.format else spark.table(self.name)

    @property
    def table(self) -> str:
        """The last part of the name, without a file's ending."""
        return self.name.rstrip("/").replace("\\", "/").rpartition("/")[2].removesuffix(".parquet").rpartition(".")[2]

    @property
    def schema(self) -> str:
        return self.name.rpartition(".")[0] or "default" if not self.format else "default"


def key_metadata(df: DataFrame, pk: Sequence[str]) -> list[dict[str, object]]:
    """attnum (place in the table, from 1), pknum (place in the key, from 1), attname and typname of each key column, as they lie in the table."""
    missing = [k for k in pk if k not in df.columns]
    if not pk or missing:
        raise C.ConfigError(f"the source must have a primary key; it lacks {missing}" if missing else "the source must have a primary key")
    kinds = dict(df.dtypes)
    return [{"attnum": i + 1, "pknum": list(pk).index(c) + 1, "attname": c, "typname": kinds[c]} for i, c in enumerate(df.columns) if c in pk]


def loaded(df: DataFrame, loading: C.Part) -> Column:
    """The column that is to be embedded."""
    if not isinstance(loading, C.LoadingColumn):
        raise C.ConfigError(f"unknown loading {getattr(loading, 'name', '')!r}")
    if loading.column_name not in df.columns:
        raise C.ConfigError(f"the source has no column {loading.column_name!r}")
    if not isinstance(df.schema[loading.column_name].dataType, StringType):
        raise C.ConfigError(f"column {loading.column_name!r} is no text")
    return F.col(f"`{loading.column_name}`")


def with_text(df: DataFrame, loading: C.Part) -> DataFrame:
    """Rows with something to embed: not null, not blank. The filter is a JVM expression, before any Python."""
    return df.where(~is_blank(loaded(df, loading)))


def dechunk(df: DataFrame, keys: Sequence[str], order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """The texts of each key joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(f"`{order}`").alias("o"), F.col(f"`{text}`").alias("t"))))
    return df.groupBy(*[f"`{k}`" for k in keys]).agg(F.array_join(F.transform(parts, lambda x: x["t"]), separator).alias(text))
