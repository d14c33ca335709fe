"""Retrieval: source and embeddings joined, nearest chunks, context for a prompt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators.embedding import cosine_similarity
from vecloom.streaming.changes import all_of

STORED = ("embedding_uuid", "chunk_seq", "chunk", "embedding")


def embedding_view(source: DataFrame, target: DataFrame, pk: Sequence[str]) -> DataFrame:
    """embedding_uuid, chunk_seq, chunk, embedding and the columns of the source."""
    t = target.select(*[F.col(c).alias(f"__{c}") for c in STORED], *[F.col(f"`{k}`").alias(f"__pk{i}") for i, k in enumerate(pk)])
    joined = source.join(t, all_of([source[f"`{k}`"] == t[f"__pk{i}"] for i, k in enumerate(pk)]))
    mine = [c for c in source.columns]
    return joined.select(*[F.col(f"__{c}").alias(c) for c in STORED if c not in mine], *[source[f"`{c}`"] for c in mine])


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def vector(values: Sequence[float]) -> Column:
    return F.lit([float(x) for x in values]).cast("array<float>")


def top_k(df: DataFrame, query: Sequence[float] | Column, k: int, tie: Sequence[str], vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to a vector, with their distance, nearest first; equal distances go by ``tie``. Each task keeps k rows."""
    query = query if isinstance(query, Column) else vector(query)
    return df.withColumn("distance", cosine_distance(F.col(f"`{vector_col}`"), query)).orderBy("distance", *[f"`{t}`" for t in tie]).limit(k)


def top_k_per_query(df: DataFrame, queries: DataFrame, k: int, tie: Sequence[str], query_id: str = "query_id", query_vector: str = "query", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of each query, with distance and rank from 1.

    All pairs are scored, so the work is that of exact search. Before the shuffle each task keeps k rows of a query (the limit is pushed below the window).
    """
    pairs = df.crossJoin(queries.select(F.col(query_id), F.col(query_vector).alias("__q")))
    scored = pairs.withColumn("distance", cosine_distance(F.col(f"`{vector_col}`"), F.col("__q"))).drop("__q")
    by = Window.partitionBy(query_id).orderBy("distance", *[F.col(f"`{t}`") for t in tie])
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def rag_context(nearest: DataFrame, text: str = "chunk", order: Sequence[str] = ("distance",), separator: str = "\n\n") -> DataFrame:
    """context: one text of the rows in order. For the few rows of a top-k."""
    parts = F.array_sort(F.collect_list(F.struct(*[F.col(f"`{o}`") for o in order], F.col(f"`{text}`").alias("__text"))))
    return nearest.agg(F.array_join(F.transform(parts, lambda x: x["__text"]), separator).alias("context"))
