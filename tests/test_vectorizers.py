"""Catalog, queue, change capture and the embedding job, end to end on small tables."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from vecloom import config as C
from vecloom.operators import embedding as E
from vecloom.operators.errors import EmbeddingError
from vecloom.plans.tracking import Tracker, heartbeat_fold, processes, progress_fold
from vecloom.plans.vectorizers import NotInstalledError, Vectorizers
from vecloom.plans.worker import Worker
from vecloom.sources.store import ConflictError, Table
from vecloom.sources.tables import Source, dechunk, key_metadata
from vecloom.streaming import changes
from vecloom.streaming.runner import read_changes, start

E.register_embedder("letters", E.letter_embedder("eta"))
LETTERS = C.EmbeddingLocal("letters", 3)


class Failing:
    max_inputs, max_tokens = 1, None

    def __init__(self, transient):
        self.transient = transient

    def embed(self, inputs):
        if any("bad" in t for t in inputs):
            raise EmbeddingError("HTTP 503 unavailable" if self.transient else "HTTP 401 invalid api key", self.transient, 503 if self.transient else 401)
        return [[1.0, 2.0, 3.0] for _ in inputs]


@pytest.fixture
def world(spark, tmp_path):
    path = str(tmp_path / "articles.parquet")

    def put(rows, schema="id long, title string, content string"):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)

    put([(1, "a", "tea. eat"), (2, "b", "meet"), (3, "c", "xyz")])
    return Vectorizers(spark, str(tmp_path / "root")), Source(path, ("id",), "parquet"), put


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_create_run_change_drop(spark, world):
    v, source, put = world
    vid = v.create(source, C.loading_column("content"), LETTERS, chunking=C.ChunkingNone(), formatting=C.FormattingTemplate("$title: $chunk"))
    assert vid == 1 and v.queue_pending(1) == 3
    assert v.target(v.get(1)).read().columns == ["embedding_uuid", "id", "chunk_seq", "chunk", "embedding"]
    done = v.run(1)
    assert (done.embedded, done.chunks, done.failed) == (3, 3, 0) and v.queue_pending(1) == 0
    assert rows(v.view(1), "id", "chunk_seq", "chunk") == [(1, 0, "a: tea. eat"), (2, 0, "b: meet"), (3, 0, "c: xyz")]
    assert set(v.view(1).columns) == {"embedding_uuid", "chunk_seq", "chunk", "embedding", "id", "title", "content"}
    assert v.run(1).taken == 0  # nothing queued, nothing done
    v.sync(1)
    assert v.queue_pending(1) == 0  # nothing changed
    put([(1, "a2", "tea. eat"), (3, "c", "xyz"), (4, "d", "new")])
    v.sync(1)
    assert v.queue_pending(1) == 2  # an update of another column, an insert; a delete queues nothing
    assert rows(v.view(1), "id") == [(1,), (3,)]
    assert v.target(v.get(1)).read().count() == 2
    v.run(1)
    assert rows(v.view(1, register=True), "id", "chunk") == [(1, "a2: tea. eat"), (3, "c: xyz"), (4, "d: new")]
    assert spark.table("articles_embedding").count() == 3
    v.truncate(1)
    assert v.target(v.get(1)).read().count() == 0
    v.record_error(1, "x")
    v.drop(1)
    assert not v.list() and v.errors.read().count() == 0
    assert v.create(source, C.loading_column("content"), LETTERS) == 2  # ids aren't used again


def test_create_refuses(spark, world):
    v, source, _ = world
    load = C.loading_column("content")
    for args, said in (
        ({"loading": load}, "embedding configuration"), ({"embedding": LETTERS}, "loading configuration"), ({"loading": load, "embedding": C.EmbeddingOllama("m")}, "dimensions"),
        ({"loading": C.loading_column("nope"), "embedding": LETTERS}, "no column"), ({"loading": C.loading_column("id"), "embedding": LETTERS}, "no text"),
        ({"loading": load, "embedding": LETTERS, "destination": C.DestinationColumn("e")}, "chunking must be none"),
    ):
        with pytest.raises(C.ConfigError, match=said):
            v.create(source, **args)
    with pytest.raises(C.ConfigError, match="primary key"):
        v.create(Source(source.name, (), "parquet"), load, LETTERS)
    one = v.create(source, load, LETTERS, enqueue_existing=False)
    assert v.queue_pending(one) == 0
    with pytest.raises(C.ConfigError, match="already exists"):
        v.create(source, load, LETTERS)
    assert v.create(source, load, LETTERS, if_not_exists=True) == one
    with pytest.raises(KeyError):
        v.queue_pending(99)
    with pytest.raises(NotInstalledError):
        Vectorizers(spark, v.root + "-other", install=False)


def test_blank_null_missing_disabled(spark, world):
    v, source, put = world
    put([(1, "a", None), (2, "b", "  \n"), (3, "c", "tea"), (4, "d", "")])
    vid = v.create(source, C.loading_column("content"), LETTERS)
    v.apply_changes(vid, spark.createDataFrame([("I", 77), ("I", 3)], "op string, id long"))
    assert v.queue_pending(vid) == 6
    v.disable(vid)
    assert v.run(vid).taken == 0 and v.queue_pending(vid) == 6
    v.disable(vid, False)
    done = v.run(vid)
    assert (done.embedded, done.skipped, done.missing) == (1, 3, 1) and v.queue_pending(vid) == 0
    # a text that becomes blank keeps its embeddings, or loses them, as told
    put([(3, "c", " ")])
    v.sync(vid)
    v.run(vid)
    assert v.target(v.get(vid)).read().count() == 1
    v.on_blank = "delete"
    v.apply_changes(vid, spark.createDataFrame([("U", 3)], "op string, id long"))
    v.run(vid)
    assert v.target(v.get(vid)).read().count() == 0


@pytest.mark.parametrize("transient", [True, False])
def test_failures(spark, world, transient, monkeypatch):
    v, source, put = world
    monkeypatch.setattr(E, "LONGEST_WAIT", 0.0)
    put([(1, "a", "good"), (2, "b", "bad"), (3, "c", "good too")])
    name = f"failing, {transient}"  # a name is registered once
    E.register_embedder(name, Failing(transient))
    vid = v.create(source, C.loading_column("content"), C.EmbeddingLocal(name, 3))
    done = v.run(vid)
    assert (done.embedded, done.retry, done.failed) == ((2, 1, 0) if transient else (2, 0, 1))
    assert v.queue_pending(vid) == int(transient)  # at least once: transient failures stay queued
    assert v.failed_queue(v.get(vid)).read().count() == int(not transient)
    (error,) = v.errors.read().collect()
    said = json.loads(error["details"])
    assert error["message"] == "embedding provider failed" and said["error_class"] == ("transient" if transient else "permanent")
    assert said["attempts"] == (3 if transient else 1) and said["provider"] == "local" and said["status_code"] == (503 if transient else 401)


def test_chunked_batches_and_composite_key(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    text = "This is a paragraph about engines. " * 20
    spark.createDataFrame([("a", 1, text, True), ("a", 2, text, False), ("b", 1, "short", None)], 'category string, seq int, content string, `order` boolean').write.parquet(path)
    v = Vectorizers(spark, str(tmp_path / "root"))
    vid = v.create(
        Source(path, ("category", "seq"), "parquet"), C.loading_column("content"), LETTERS, chunking=C.ChunkingRecursive(100, 0), formatting=C.FormattingTemplate("$order $seq $chunk"), processing=C.Processing(batch_size=2, concurrency=2)
    )
    v.run(vid)
    got = v.target(v.get(vid)).read()
    assert got.select("category", "seq", "chunk_seq").distinct().count() == got.count() > 10
    for r in got.groupBy("category", "seq").agg(F.array_sort(F.collect_list("chunk_seq")).alias("n")).collect():
        assert r["n"] == list(range(len(r["n"])))
    assert rows(got.where("category = 'b'"), "chunk") == [(" 1 short",)]
    key = key_metadata(v.get(vid).source.read(spark), ("seq", "category"))
    assert [(k["attname"], k["attnum"], k["pknum"]) for k in key] == [("category", 1, 2), ("seq", 2, 1)]


def test_column_destination(spark, world):
    v, source, put = world
    vid = v.create(source, C.loading_column("content"), LETTERS, chunking=C.ChunkingNone(), destination=C.DestinationColumn("vec"))
    v.run(vid, lambda: False)
    assert rows(v.view(vid), "id", "vec") == [(1, [2.0, 2.0, 2.0]), (2, [2.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0])]
    put([(1, "a", "eee"), (2, "b", "meet")])
    v.sync(vid)
    v.run(vid)
    assert rows(v.view(vid), "id", "vec") == [(1, [3.0, 0.0, 0.0]), (2, [2.0, 1.0, 0.0])]


def test_stream_restart_does_nothing_twice(spark, world, tmp_path):
    v, source, put = world
    vid = v.create(source, C.loading_column("content"), LETTERS, enqueue_existing=False)
    feed, schema = str(tmp_path / "feed"), "op string, id long, old_id long"
    spark.createDataFrame([("I", 1, None), ("I", 1, None), ("I", 2, None)], schema).write.parquet(feed)
    for _ in range(2):
        start(v, vid, read_changes(spark, feed, schema), str(tmp_path / "checkpoint")).awaitTermination()
        assert rows(v.target(v.get(vid)).read(), "id") == [(1,), (2,)]
    version = v.target(v.get(vid)).version
    start(v, vid, read_changes(spark, feed, schema), str(tmp_path / "checkpoint")).awaitTermination()
    assert v.target(v.get(vid)).version == version
    put([(3, "c", "xyz"), (9, "b", "meet")])
    spark.createDataFrame([("D", 1, None), ("U", 9, 2), ("I", 3, None)], schema).write.mode("append").parquet(feed)
    start(v, vid, read_changes(spark, feed, schema), str(tmp_path / "checkpoint")).awaitTermination()
    assert rows(v.target(v.get(vid)).read(), "id") == [(3,), (9,)]


def test_diff_and_events(spark):
    schema = "a int, b int, x string, y int"
    old = spark.createDataFrame([(1, 1, "p", None), (1, 2, "q", 1), (1, 3, None, 1), (2, 1, "s", 1)], schema)
    new = spark.createDataFrame([(1, 1, "p", None), (1, 2, "q", 2), (1, 3, "r", 1), (3, 1, "s", 1)], schema)
    assert rows(changes.diff(old, new, ["a", "b"]), "op", "a", "b") == [("D", 2, 1), ("I", 3, 1), ("U", 1, 2), ("U", 1, 3)]
    keys = old.select("a", "b")
    assert changes.diff(keys, keys, ["a", "b"]).count() == 0
    assert rows(changes.diff(changes.row_hash(old, ["a", "b"]), changes.row_hash(new, ["a", "b"]), ["a", "b"]), "op", "a", "b") == [("D", 2, 1), ("I", 3, 1), ("U", 1, 2), ("U", 1, 3)]
    events = spark.createDataFrame([("U", 1, True, 1), ("U", 1, False, 2), ("I", 2, None, 3), ("D", 1, None, 4)], "op string, id int, changed boolean, n int")
    assert rows(changes.keys_to_queue(events, ["id"]), "id") == [(1,), (2,)]
    assert rows(changes.keys_to_drop(events, ["id"]), "id") == [(1,)]
    assert rows(changes.last_per_key(events, ["id"], ["n"]), "id", "op") == [(1, "D"), (2, "I")]


def test_table_log(spark, tmp_path):
    schema = spark.createDataFrame([], "id int, x string").schema
    t = Table.create(spark, str(tmp_path / "t"), schema, ["id"])
    assert t.read().count() == 0 and t.version == 0
    df = lambda *r: spark.createDataFrame(list(r), "id int, x string")
    first = t.append(df((1, "a"), (2, "b"), (None, "n")))
    t.append(df((9, "z")), token="k")
    t.append(df((9, "z")), token="k")
    t.replace(df((1, ""), (None, "")), df((1, "a2"), (1, "a3")))
    assert rows(t.read().fillna(-1), "id", "x") == [(1, "a2"), (1, "a3"), (2, "b"), (9, "z")]
    assert rows(t.read(first).fillna(-1), "id", "x") == [(-1, "n"), (1, "a"), (2, "b")]
    seen = t.version
    t.append(df((2, "later")))
    t.delete(df((2, "")), upto=seen)
    assert rows(t.read(), "id", "x") == [(1, "a2"), (1, "a3"), (2, "later"), (9, "z")]
    t.compact()
    t.vacuum()
    assert rows(t.read(), "id", "x") == [(1, "a2"), (1, "a3"), (2, "later"), (9, "z")]
    t.append(df((9, "z")), token="k")
    with pytest.raises(ConflictError):
        t._commit(t.version, False, None, None, None)
    t.overwrite(df((5, "e")).withColumn("more", F.lit(1)))
    assert rows(t.read(), "id", "x") == [(5, "e")]
    t.truncate()
    assert t.read().count() == 0


def test_tracking_folds(spark):
    beats = spark.createDataFrame([("w", i, s, e, m) for i, (s, e, m) in enumerate([(10, 0, None), (5, 3, "down"), (7, 0, None), (0, 1, "again")])], "worker_id string, at int, successes long, errors long, message string")
    for n, want in ((1, (1, 10, 0, None)), (2, (2, 15, 3, "down")), (3, (3, 22, 3, "down")), (4, (4, 22, 4, "again"))):
        (r,) = heartbeat_fold(beats.where(f"at < {n}")).collect()
        assert (r["heartbeat_count"], r["success_count"], r["error_count"], r["last_error_message"]) == want
    steps = spark.createDataFrame([(1, "w", 0, 5, None), (1, "w", 1, 0, "no model"), (1, "x", 2, 3, None), (1, "x", 3, 10, None)], "vectorizer_id long, worker_id string, at int, successes long, message string")
    for n, want in ((1, (5, 0)), (2, (5, 1)), (3, (8, 1)), (4, (18, 1))):
        (r,) = progress_fold(steps.where(f"at < {n}")).collect()
        assert (r["success_count"], r["error_count"]) == want
    assert (r["last_success_process_id"], r["last_error_process_id"], r["last_error_message"]) == ("x", "w", "no model")


def test_tracker_restores_counts_and_worker_runs(spark, world, tmp_path, monkeypatch):
    v, source, _ = world
    v.create(source, C.loading_column("content"), LETTERS)
    v.create(source, C.loading_column("content"), C.EmbeddingLocal("no such", 3), name="broken")
    tracker = Tracker(spark, str(tmp_path / "tracking"), interval=timedelta(hours=1))
    with pytest.raises(C.ConfigError):
        Worker(v, once=True, tracker=tracker).run()
    assert v.target(v.get(1)).read().count() == 3  # one failure doesn't stop the others
    (r,) = processes(tracker.table("starts").read(), tracker.table("beats").read()).collect()
    assert (r["success_count"], r["error_count"]) == (3, 1)
    Worker(v, ids=[1, 50], once=True).run()
    with pytest.raises(KeyError):
        Worker(v, ids=[50], once=True, strict=True).run()
    tracker.count(2, 1, "m")
    monkeypatch.setattr(tracker, "_append", lambda *_: 1 / 0)
    for _ in range(3):
        with pytest.raises(ZeroDivisionError):
            tracker.heartbeat()
    assert (tracker.successes, tracker.errors, tracker.message, tracker.healthy) == (2, 1, "m", False)
    monkeypatch.setenv("VECLOOM_FAIL_ON_HEARTBEAT_LOSS", "yes")
    with pytest.raises(RuntimeError):
        tracker.check()


def test_dechunk(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "k int, n int, t string")
    assert rows(dechunk(df, ["k"], "n", "t"), "k", "t") == [(1, "a\n\nb"), (2, "")]
