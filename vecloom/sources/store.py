"""Tables that change by key, as Parquet files and a log of commits.

A commit is one small file, made under the next free number and never over another, so of two writers that race one comes second
and nothing is half done. It names a folder of rows to add, a folder of keys whose earlier rows are dead, or both. Who comes second writes again.
A read takes the rows since the last full commit, without those whose key a later commit has killed: writing costs what changed,
not what there is. ``compact`` folds the log into one full commit.

Values of keys compare with ``<=>``: a null in a key equals a null.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import wraps
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

VERSION, UPTO = "__version", "__upto"
#: Commits after which a write folds the log.
COMPACT_AFTER = 32
#: Tries of a write against others.
ATTEMPTS = 10


class ConflictError(RuntimeError):
    """Another writer made the commit first."""


def _again(write: Callable[..., int]) -> Callable[..., int]:
    """A write that lost the race for its number is made again after what the other wrote."""

    @wraps(write)
    def repeated(*args: Any, **named: Any) -> int:
        for _ in range(ATTEMPTS - 1):
            try:
                return write(*args, **named)
            except ConflictError:
                continue
        return write(*args, **named)

    return repeated


class Files:
    """The few operations on files that a log needs, on whatever file system a path is of."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, path: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Fails if there is such a file."""
        try:
            stream = self.fs.create(self._path(path), False)
        except Exception as e:
            if self.exists(path):
                raise ConflictError(path) from e
            raise
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


@dataclass(frozen=True)
class Commit:
    version: int
    full: bool
    rows: str | None
    keys: str | None
    token: str | None

    @classmethod
    def of(cls, version: int, text: str) -> Commit:
        said = json.loads(text)
        return cls(version, said["full"], said.get("rows"), said.get("keys"), said.get("token"))


class Table:
    """A table at ``path`` with key columns ``pk``; made by :meth:`create` or opened as it is."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        if not self.files.exists(f"{self.path}/schema.json"):
            raise FileNotFoundError(f"no table at {self.path}")
        said = json.loads(self.files.read(f"{self.path}/schema.json"))
        self.pk: list[str] = said["pk"]
        self.schema = StructType.fromJson(said["schema"])

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, pk: Sequence[str]) -> Table:
        """Opens it if it is there."""
        path = path.rstrip("/")
        files = Files(spark, path)
        missing = [k for k in pk if k not in schema.fieldNames()]
        if missing:
            raise ValueError(f"key columns that the table lacks: {missing}")
        if not files.exists(f"{path}/schema.json"):
            try:
                files.create(f"{path}/schema.json", json.dumps({"pk": list(pk), "schema": schema.jsonValue()}))
            except ConflictError:
                pass  # another made it
        return cls(spark, path)

    def drop(self) -> None:
        self.files.delete(self.path)

    # the log --------------------------------------------------------------------------------------------------

    def _log(self, upto: int | None = None) -> list[Commit]:
        """Commits since the last full one, oldest first."""
        out: list[Commit] = []
        for name in reversed(self.files.names(f"{self.path}/log")):
            if not name.endswith(".json") or upto is not None and int(name[:-5]) > upto:
                continue
            out.append(Commit.of(int(name[:-5]), self.files.read(f"{self.path}/log/{name}")))
            if out[-1].full:
                break
        return out[::-1]

    @property
    def version(self) -> int:
        """Of the last commit; 0 before the first."""
        names = [n for n in self.files.names(f"{self.path}/log") if n.endswith(".json")]
        return int(names[-1][:-5]) if names else 0

    def has_token(self, token: str) -> bool:
        """A writer that is lost between its commit and its token file has left the token in the commit."""
        return self.files.exists(f"{self.path}/tokens/{token}") or any(c.token == token for c in self._log())

    def _commit(self, version: int, full: bool, rows: str | None, keys: str | None, token: str | None) -> int:
        said = {"full": full, "rows": rows, "keys": keys, "token": token}
        self.files.create(f"{self.path}/log/{version:012d}.json", json.dumps(said))
        if token:
            self.files.create(f"{self.path}/tokens/{token}", str(version))
        return version

    def _written(self, df: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _conformed(self, df: DataFrame) -> DataFrame:
        """Columns by name, in the table's order and types; columns that ``df`` lacks are null, others aren't stored."""
        have = set(df.columns)
        missing = [k for k in self.pk if k not in have]
        if missing:
            raise ValueError(f"key columns that the rows lack: {missing}")
        return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    # writing --------------------------------------------------------------------------------------------------

    @_again
    def append(self, rows: DataFrame, token: str | None = None) -> int:
        """Adds rows. With a token that was committed before, nothing is done."""
        if token and self.has_token(token):
            return self.version
        version = self.version + 1
        name = self._written(self._conformed(rows).withColumn(VERSION, F.lit(version).cast("long")))
        return self._settled(self._commit(version, False, name, None, token))

    @_again
    def replace(self, keys: DataFrame, rows: DataFrame, token: str | None = None) -> int:
        """All rows of ``keys`` go, and ``rows`` come, at once."""
        if token and self.has_token(token):
            return self.version
        version = self.version + 1
        gone = self._written(keys.select(*[F.col(f"`{k}`").cast(self.schema[k].dataType).alias(k) for k in self.pk]).distinct().withColumn(UPTO, F.lit(version - 1).cast("long")))
        name = self._written(self._conformed(rows).withColumn(VERSION, F.lit(version).cast("long")))
        return self._settled(self._commit(version, False, name, gone, token))

    @_again
    def delete(self, keys: DataFrame, upto: int | None = None, token: str | None = None) -> int:
        """All rows of ``keys`` that were committed by version ``upto`` go; rows added since then stay."""
        if token and self.has_token(token):
            return self.version
        version = self.version + 1
        last = version - 1 if upto is None else upto
        gone = self._written(keys.select(*[F.col(f"`{k}`").cast(self.schema[k].dataType).alias(k) for k in self.pk]).distinct().withColumn(UPTO, F.lit(last).cast("long")))
        return self._settled(self._commit(version, False, None, gone, token))

    @_again
    def truncate(self) -> int:
        return self._commit(self.version + 1, True, None, None, None)

    @_again
    def overwrite(self, rows: DataFrame) -> int:
        version = self.version + 1
        name = self._written(self._conformed(rows).withColumn(VERSION, F.lit(version).cast("long")))
        return self._commit(version, True, name, None, None)

    @_again
    def compact(self) -> int:
        """One full commit of what a read gives; rows keep their versions. Old files stay for readers until :meth:`vacuum`."""
        version = self.version
        return self._commit(version + 1, True, self._written(self._live(self._log(version))), None, None)

    def _settled(self, version: int) -> int:
        if len(self._log()) > COMPACT_AFTER:
            return self.compact()
        return version

    def vacuum(self) -> None:
        """Deletes files that no commit since the last full one names. Only when nobody reads an older version."""
        log = self._log()
        used = {x.rpartition("/")[2] for c in log for x in (c.rows, c.keys) if x}
        for name in self.files.names(f"{self.path}/data"):
            if name not in used:
                self.files.delete(f"{self.path}/data/{name}")
        for name in self.files.names(f"{self.path}/log"):
            if log and name.endswith(".json") and int(name[:-5]) < log[0].version:
                self.files.delete(f"{self.path}/log/{name}")

    # reading --------------------------------------------------------------------------------------------------

    def _live(self, log: list[Commit]) -> DataFrame:
        stored = StructType([*self.schema.fields]).add(VERSION, LongType())
        names = [f"{self.path}/{c.rows}" for c in log if c.rows]
        # files lack columns that came later, and an empty list of paths is an error
        rows = self.spark.read.schema(stored).parquet(*names) if names else self.spark.createDataFrame([], stored)
        gone = [f"{self.path}/{c.keys}" for c in log if c.keys]
        if not gone or not names:
            return rows
        key = StructType([self.schema[k] for k in self.pk]).add(UPTO, LongType())
        dead = self.spark.read.schema(key).parquet(*gone).groupBy(*[f"`{k}`" for k in self.pk]).agg(F.max(UPTO).alias(UPTO))
        dead = dead.select(*[F.col(f"`{k}`").alias(f"__dead_{i}") for i, k in enumerate(self.pk)], UPTO)
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__dead_{i}")) for i, k in enumerate(self.pk)]
        on = same[0]
        for x in same[1:]:
            on = on & x
        return rows.join(dead, on & (F.col(VERSION) <= F.col(UPTO)), "left_anti")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, the last by default."""
        return self._live(self._log(version)).drop(VERSION)
