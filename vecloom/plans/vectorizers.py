"""Vectorizers: definitions, queues, and the job that brings embeddings up to date."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from vecloom import config as C
from vecloom.operators import embedding as E
from vecloom.operators.chunking import chunk_column, is_blank
from vecloom.operators.formatting import format_chunks
from vecloom.plans.retrieval import embedding_view
from vecloom.sources.store import Files, Table
from vecloom.sources.tables import Source, key_metadata, loaded
from vecloom.streaming import changes

_S, _L, _T = StringType(), LongType(), TimestampType()
CATALOG = StructType(
    [
        StructField("id", _L), StructField("name", _S), StructField("source_schema", _S), StructField("source_table", _S), StructField("source_name", _S), StructField("source_format", _S),
        StructField("source_pk", _S), StructField("queue_schema", _S), StructField("queue_table", _S), StructField("queue_failed_table", _S), StructField("config", _S), StructField("disabled", BooleanType()),
    ]
)
ERRORS = StructType([StructField("id", _L), StructField("message", _S), StructField("details", _S), StructField("recorded", _T)])
MARKER = "vecloom.json"


class NotInstalledError(RuntimeError):
    """There is no catalog at this root."""


@dataclass(frozen=True)
class Vectorizer:
    id: int
    name: str
    source: Source
    config: C.Config
    queue: str
    failed: str
    disabled: bool


@dataclass(frozen=True)
class Done:
    """Keys of one pass. ``retry``: transient failures, still queued; ``failed``: permanent ones, in the failed queue."""

    embedded: int = 0
    chunks: int = 0
    skipped: int = 0
    missing: int = 0
    retry: int = 0
    failed: int = 0

    @property
    def taken(self) -> int:
        return self.embedded + self.skipped + self.missing + self.failed


def target_schema(source: StructType, pk: Sequence[str]) -> StructType:
    """embedding_uuid, the key, chunk_seq, chunk, embedding."""
    out = StructType([StructField("embedding_uuid", _S)])
    for k in pk:
        out.add(source[k])
    return out.add("chunk_seq", IntegerType()).add("chunk", _S).add("embedding", ArrayType(FloatType()))


class Vectorizers:
    """All vectorizers under ``root``, a folder that driver and executors share.

    ``on_blank``: what becomes of the embeddings of a key whose text is now null or blank, "keep" or "delete".
    ``prune``: put into templates only columns that the template names, so that no others are read; otherwise a $name within a chunk is replaced too.
    """

    def __init__(
        self, spark: SparkSession, root: str, secrets: E.Secrets | None = None, tokenizer: E.Tokenizer | None = None, on_blank: str = "keep", prune: bool = False, clock: Callable[[], datetime] | None = None, install: bool = True
    ) -> None:
        self.spark, self.root, self.secrets, self.tokenizer, self.on_blank, self.prune = spark, root.rstrip("/"), secrets, tokenizer, on_blank, prune
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        self.files = Files(spark, self.root)
        if not self.files.exists(f"{self.root}/{MARKER}"):
            if not install:
                raise NotInstalledError(self.root)
            self.files.create(f"{self.root}/{MARKER}", json.dumps({"version": "0.1.0"}))

    # tables ---------------------------------------------------------------------------------------------------

    def _table(self, name: str, schema: StructType | None = None, pk: Sequence[str] = ()) -> Table:
        path = f"{self.root}/tables/{name}"
        return Table.create(self.spark, path, schema, pk) if schema is not None else Table(self.spark, path)

    @property
    def catalog(self) -> Table:
        return self._table("vectorizer", CATALOG, ["id"])

    @property
    def errors(self) -> Table:
        return self._table("vectorizer_errors", ERRORS, ["id"])

    def queue(self, v: Vectorizer) -> Table:
        return self._table(v.queue)

    def failed_queue(self, v: Vectorizer) -> Table:
        return self._table(v.failed)

    def _target_name(self, config: C.Config) -> str:
        d = config.destination
        return f"{d.target_schema}.{d.target_table}" if isinstance(d, C.DestinationTable) else ""

    def target(self, v: Vectorizer) -> Table:
        """Of a table destination the embedding store; of a column destination the column's values by key."""
        return self._table(self._target_name(v.config) or f"column_{v.id}")

    # definitions ----------------------------------------------------------------------------------------------

    def create(
        self,
        source: Source,
        loading: C.Part | None = None,
        embedding: C.Part | None = None,
        chunking: C.Part = C.ChunkingRecursive(),
        formatting: C.Part = C.FormattingTemplate(),
        processing: C.Part = C.Processing(),
        destination: C.Part = C.DestinationTable(),
        queue_schema: str = "ai",
        queue_table: str | None = None,
        enqueue_existing: bool = True,
        name: str | None = None,
        if_not_exists: bool = False,
    ) -> int:
        """The id. Of a name that is taken, an error, or with ``if_not_exists`` the id that it has."""
        if embedding is None:
            raise C.ConfigError("embedding configuration is required")
        if loading is None:
            raise C.ConfigError("loading configuration is required")
        if getattr(embedding, "dimensions", None) is None:
            raise C.ConfigError("dimensions are required in the embedding configuration")
        rows = source.read(self.spark)
        key = key_metadata(rows, source.pk)
        loaded(rows, loading)
        if isinstance(destination, C.DestinationColumn):
            if not isinstance(chunking, C.ChunkingNone):
                raise C.ConfigError("a column destination holds one embedding a row: chunking must be none")
            name = name or f"{source.schema}_{source.table}_{destination.embedding_column}"
        else:
            destination = C.DestinationTable(
                destination.target_schema or source.schema, destination.target_table or f"{source.table}_embedding_store", destination.view_schema or source.schema, destination.view_name or f"{source.table}_embedding"
            )
            name = name or f"{destination.target_schema}_{destination.target_table}"
        taken = self.catalog.read().where(F.col("name") == name).first()
        if taken:
            if if_not_exists:
                return taken["id"]
            raise C.ConfigError(f"a vectorizer named {name} already exists")
        config = C.Config(loading, embedding, destination, chunking, formatting, processing)
        vid = self._next_id()
        v = Vectorizer(vid, name, source, config, f"{queue_schema}.{queue_table or f'_vectorizer_q_{vid}'}", f"{queue_schema}._vectorizer_q_failed_{vid}", False)
        keys = StructType([rows.schema[k] for k in source.pk])
        self._table(v.queue, StructType(list(keys.fields)).add("queued_at", _T), source.pk)
        self._table(v.failed, StructType(list(keys.fields)).add("created_at", _T).add("failure_step", _S), source.pk)
        self._table(f"_seen_{vid}", StructType(list(keys.fields)).add("row_hash", _L), source.pk)
        stored = target_schema(rows.schema, source.pk) if isinstance(destination, C.DestinationTable) else StructType(list(keys.fields)).add(destination.embedding_column, ArrayType(FloatType()))
        self._table(self._target_name(config) or f"column_{vid}", stored, source.pk)
        row = (vid, name, source.schema, source.table, source.name, source.format, json.dumps(key), queue_schema, v.queue, v.failed, config.to_json(), False)
        self.catalog.append(self.spark.createDataFrame([row], CATALOG))
        if enqueue_existing:
            self._enqueue(v, rows.select(*[F.col(f"`{k}`") for k in source.pk]))
        self._table(f"_seen_{vid}").overwrite(changes.row_hash(rows, source.pk))
        return vid

    def _next_id(self) -> int:
        """Ids are never used again; two drivers can't get the same."""
        used = self.files.names(f"{self.root}/ids")
        vid = int(used[-1]) + 1 if used else 1
        self.files.create(f"{self.root}/ids/{vid:09d}", "")
        return vid

    def list(self, ids: Sequence[int] | None = None) -> list[Vectorizer]:
        rows = self.catalog.read()
        rows = rows.where(F.col("id").isin(list(ids))) if ids is not None else rows
        return [self._vectorizer(r) for r in rows.orderBy("id").collect()]

    def _vectorizer(self, r) -> Vectorizer:  # noqa: ANN001
        pk = tuple(k["attname"] for k in sorted(json.loads(r["source_pk"]), key=lambda k: k["pknum"]))
        return Vectorizer(r["id"], r["name"], Source(r["source_name"], pk, r["source_format"]), C.Config.from_json(r["config"]), r["queue_table"], r["queue_failed_table"], r["disabled"])

    def get(self, vid: int) -> Vectorizer:
        found = self.list([vid])
        if not found:
            raise KeyError(f"vectorizer {vid} not found")
        return found[0]

    def disable(self, vid: int, disabled: bool = True) -> None:
        self.get(vid)
        row = self.catalog.read().where(F.col("id") == vid).withColumn("disabled", F.lit(disabled))
        self.catalog.replace(row.select("id"), row)

    def drop(self, vid: int, drop_all: bool = True) -> None:
        """The definition, its changes' state and its errors; with ``drop_all`` also queues, target and view."""
        v = self.get(vid)
        self._table(f"_seen_{vid}").drop()
        if drop_all:
            for table in (self.queue(v), self.failed_queue(v), self.target(v)):
                table.drop()
            if isinstance(v.config.destination, C.DestinationTable):
                self.spark.catalog.dropTempView(v.config.destination.view_name)
        one = self.spark.createDataFrame([(vid,)], "id long")
        self.errors.delete(one)
        self.catalog.delete(one)

    def queue_pending(self, vid: int) -> int:
        """Queued rows, duplicates included."""
        return self.queue(self.get(vid)).read().count()

    def status(self) -> DataFrame:
        """id, source, target, view, pending."""
        rows = [
            (v.id, v.source.name, self._target_name(v.config) or v.config.destination.embedding_column, getattr(v.config.destination, "view_name", None), self.queue(v).read().count()) for v in self.list()
        ]
        return self.spark.createDataFrame(rows, "id long, source string, target string, view string, pending long")

    def without_queue(self) -> list[int]:
        """Vectorizers whose queue is gone."""
        return [v.id for v in self.list() if not self.files.exists(f"{self.root}/tables/{v.queue}/schema.json")]

    # changes --------------------------------------------------------------------------------------------------

    def _enqueue(self, v: Vectorizer, keys: DataFrame, token: str | None = None) -> None:
        self.queue(v).append(keys.withColumn("queued_at", F.lit(self.clock())), token)

    def apply_changes(self, vid: int, events: DataFrame, token: str | None = None) -> None:
        """Queues what was inserted or updated; embeddings of deleted and of former keys go. With a token, once only."""
        v = self.get(vid)
        self._enqueue(v, changes.keys_to_queue(events, v.source.pk), token)
        if isinstance(v.config.destination, C.DestinationTable):
            self.target(v).delete(changes.keys_to_drop(events, v.source.pk), token=token)

    def sync(self, vid: int) -> None:
        """Applies what has changed in the source since it was last looked at."""
        v, seen = self.get(vid), self._table(f"_seen_{vid}")
        staged = self._staged(changes.row_hash(v.source.read(self.spark), v.source.pk), vid)
        # if this breaks off here, the next time queues these keys again, which does no harm
        self.apply_changes(vid, changes.diff(seen.read(), staged, v.source.pk))
        seen.overwrite(staged)
        self._unstage(vid)

    def truncate(self, vid: int) -> None:
        """The source was emptied."""
        v = self.get(vid)
        self.target(v).truncate()
        self.queue(v).truncate()

    # work -----------------------------------------------------------------------------------------------------

    def _staged(self, df: DataFrame, vid: int) -> DataFrame:
        path = f"{self.root}/staging/{vid}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _unstage(self, vid: int) -> None:
        self.files.delete(f"{self.root}/staging/{vid}")

    def embedder(self, v: Vectorizer) -> E.Embedder:
        return E.make_embedder(v.config.embedding, self.secrets, self.tokenizer)

    def run_once(self, vid: int, limit: int | None = None) -> Done:
        """One pass over the queue, or over ``limit`` of its keys."""
        v = self.get(vid)
        if v.disabled:
            return Done()
        pk, cfg, queue = list(v.source.pk), v.config, self.queue(v)
        upto = queue.version
        keys = queue.read(upto).select(*[f"`{k}`" for k in pk]).distinct()
        keys = self._staged(keys.orderBy(*[f"`{k}`" for k in pk]).limit(limit) if limit is not None else keys, vid)
        taken = keys.count()
        if not taken:
            return Done()
        source = v.source.read(self.spark)
        text = loaded(source, cfg.loading)
        rows = source.join(keys, pk, "left_semi")
        fields = [c for c in source.columns if not self.prune or f"${c}" in getattr(cfg.formatting, "template", "")]
        fields = fields if isinstance(cfg.formatting, C.FormattingTemplate) else []
        embedder = self.embedder(v)
        embed = lambda inputs: E.with_retry(lambda: embedder.embed(inputs))[0]
        chunks = chunk_column(text, cfg.chunking, embed)
        # a source may have a column of any name, so the operator's own have others
        key = F.struct(*[F.col(f"`{k}`") for k in pk]).alias("__key")
        flat = rows.where(~is_blank(text)).select(*[F.col(f"`{c}`") for c in fields], key, F.posexplode(chunks).alias("__seq", "__chunk"))
        said = format_chunks(flat, cfg.formatting, "__chunk", fields).select(F.col("__key").alias("key"), F.col("__seq").alias("seq"), F.col("__chunk").alias("chunk"))
        if cfg.processing.concurrency:
            said = said.repartition(cfg.processing.executors)
        # written once: nothing that is asked of it below calls the provider again
        done = self._staged(E.embed_chunks(said, embedder, "chunk", getattr(cfg.embedding, "dimensions", None)), vid)

        bad = done.where("error IS NOT NULL").groupBy("key").agg(F.max((F.col("error_class") == "permanent").cast("int")).alias("permanent"))
        good = done.join(bad, "key", "left_anti")
        flat_key = [F.col(f"key.`{k}`").alias(k) for k in pk]
        there = self._staged(keys.join(source.select(*[f"`{k}`" for k in pk], is_blank(text).alias("__blank")), pk, "left"), vid)
        missing = there.where("__blank IS NULL").select(*[f"`{k}`" for k in pk])
        with_chunks = done.select("key").distinct().select(*flat_key)
        blank = there.where("__blank IS NOT NULL").drop("__blank").join(with_chunks, pk, "left_anti")
        good_keys = good.select("key").distinct().select(*flat_key)
        gone = missing.unionByName(blank) if self.on_blank == "delete" else missing
        if isinstance(cfg.destination, C.DestinationTable):
            out = good.select(F.expr("uuid()").alias("embedding_uuid"), *flat_key, F.col("seq").alias("chunk_seq"), "chunk", "embedding")
        else:
            out = good.select(*flat_key, F.col("embedding").alias(cfg.destination.embedding_column))
        self.target(v).replace(good_keys.unionByName(gone), out)

        permanent = bad.where("permanent = 1").select(*flat_key)
        counts = bad.agg(F.count("*").alias("n"), F.coalesce(F.sum("permanent"), F.lit(0)).alias("p")).first()
        if counts["n"]:
            self._record_failures(v, done)
            self.failed_queue(v).append(permanent.withColumn("created_at", F.lit(self.clock())).withColumn("failure_step", F.lit("embed")))
        finished = keys.join(bad.where("permanent = 0").select(*flat_key), pk, "left_anti") if counts["n"] > counts["p"] else keys
        queue.delete(finished, upto)  # what was queued meanwhile stays
        n = good.agg(F.count("*").alias("chunks"), F.countDistinct("key").alias("keys")).first()
        lost = missing.count()
        result = Done(n["keys"], n["chunks"], taken - n["keys"] - counts["n"] - lost, lost, counts["n"] - counts["p"], counts["p"])
        self._unstage(vid)
        return result

    def _record_failures(self, v: Vectorizer, done: DataFrame) -> None:
        """A row for each kind of failure of a pass."""
        e = v.config.embedding
        kinds = done.where("error IS NOT NULL").groupBy("error", "error_class", "status_code", "error_code").agg(F.count("*").alias("chunks"), F.max("attempts").alias("attempts"))
        details = F.to_json(
            F.struct(
                F.lit(C.IMPLEMENTATIONS[type(e)][1]).alias("provider"), F.lit(e.model).alias("model"), "error_class", "status_code", "error_code", F.lit(E.ATTEMPTS).alias("max_attempts"), F.col("error").alias("error_reason"), "attempts", "chunks"
            )
        )
        self.errors.append(kinds.select(F.lit(v.id).cast("long").alias("id"), F.lit("embedding provider failed").alias("message"), details.alias("details"), F.lit(self.clock()).alias("recorded")))

    def record_error(self, vid: int, message: str, details: dict | None = None) -> None:
        self.errors.append(self.spark.createDataFrame([(vid, message, json.dumps(details or {}), self.clock())], ERRORS))

    def run(self, vid: int, stop: Callable[[], bool] = lambda: False) -> Done:
        """Passes until the queue is empty or only failures are left. ``stop`` is asked between passes."""
        total, size = Done(), self.get(vid).config.processing.batch_size
        while not stop():
            done = self.run_once(vid, size)
            total = replace(total, **{f: getattr(total, f) + getattr(done, f) for f in total.__dataclass_fields__})
            if not done.taken or done.retry or size is None:
                break
        return total

    # results --------------------------------------------------------------------------------------------------

    def view(self, vid: int, register: bool = False) -> DataFrame:
        """The source joined with its embeddings; of a column destination, the source with the column, as before where nothing new was embedded."""
        v = self.get(vid)
        source, stored, pk = v.source.read(self.spark), self.target(v).read(), list(v.source.pk)
        if isinstance(v.config.destination, C.DestinationTable):
            out, name = embedding_view(source, stored, pk), v.config.destination.view_name
        else:
            column, name = v.config.destination.embedding_column, None
            out = with_column(source, stored, pk, column)
        if register and name:
            out.createOrReplaceTempView(name)
        return out


def with_column(source: DataFrame, values: DataFrame, pk: Sequence[str], column: str) -> DataFrame:
    """``source`` with ``column`` from ``values``, or as it was where there is none."""
    new = values.select(*[F.col(f"`{k}`") for k in pk], F.col(f"`{column}`").alias("__new"))
    old = F.col(f"`{column}`") if column in source.columns else F.lit(None)
    return source.join(new, list(pk), "left").withColumn(column, F.coalesce(F.col("__new"), old)).drop("__new")
