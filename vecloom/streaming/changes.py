"""Changes of a source: from two snapshots, or from a feed of events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "I", "U", "D"


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def diff(old: DataFrame, new: DataFrame, pk: Sequence[str]) -> DataFrame:
    """op and key of each row inserted, updated in any column outside the key, or deleted.

    A table with nothing outside its key has no updates; a changed key is a delete and an insert. Columns that one side lacks count as null there.
    """
    rest = list(dict.fromkeys(c for c in [*old.columns, *new.columns] if c not in pk))

    def side(df: DataFrame, tag: str) -> DataFrame:
        values = [(F.col(f"`{c}`") if c in df.columns else F.lit(None)).alias(f"v{i}") for i, c in enumerate(rest)]
        return df.select(*[F.col(f"`{k}`").alias(f"{tag}{i}") for i, k in enumerate(pk)], F.struct(F.lit(True).alias("here"), *values).alias(tag))

    a, b = side(old, "a"), side(new, "b")
    on = all_of([F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) for i in range(len(pk))])
    op = F.when(F.col("a").isNull(), INSERT).when(F.col("b").isNull(), DELETE).otherwise(UPDATE)
    both = a.join(b, on, "full_outer")
    key = [F.when(F.col("b").isNull(), F.col(f"a{i}")).otherwise(F.col(f"b{i}")).alias(k) for i, k in enumerate(pk)]
    # equal rows go before the projection: structs compare with <=> field by field
    changed = ~F.col("a").eqNullSafe(F.col("b"))
    return both.where(changed).select(op.alias("op"), *key)


def row_hash(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Key and a 64-bit hash of the rest: what is kept of a snapshot to tell later what has changed."""
    rest = sorted(c for c in df.columns if c not in pk)
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in rest], *[F.col(f"`{c}`").isNull() for c in rest]) if rest else F.lit(0).cast("long")
    return df.select(*[F.col(f"`{k}`") for k in pk], hashed.alias("row_hash"))


def last_per_key(events: DataFrame, pk: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the events of a key, the last by ``order``."""
    by = Window.partitionBy(*[F.col(f"`{k}`") for k in pk]).orderBy(*[F.col(f"`{o}`").desc_nulls_last() for o in order])
    return events.withColumn("__k", F.row_number().over(by)).where(F.col("__k") == 1).drop("__k")


def keys_to_queue(events: DataFrame, pk: Sequence[str]) -> DataFrame:
    """A row for each insert and for each update that changed something; duplicates stay.

    Events have op and the key; an optional boolean ``changed`` tells updates that changed nothing.
    """
    found = events.where(F.col("op").isin(INSERT, UPDATE))
    if "changed" in events.columns:
        found = found.where((F.col("op") == INSERT) | F.coalesce("changed", F.lit(True)))
    return found.select(*[F.col(f"`{k}`") for k in pk])


def keys_to_drop(events: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Keys whose embeddings go: of deletes, and the former key (columns ``old_<key>``) of updates that changed it."""
    gone = events.where(F.col("op") == DELETE).select(*[F.col(f"`{k}`") for k in pk])
    old = [f"old_{k}" for k in pk]
    if all(c in events.columns for c in old):
        moved = any_of([~F.col(f"`{o}`").eqNullSafe(F.col(f"`{k}`")) for o, k in zip(old, pk)]) & any_of([F.col(f"`{o}`").isNotNull() for o in old])
        gone = gone.unionByName(events.where((F.col("op") == UPDATE) & moved).select(*[F.col(f"`{o}`").alias(k) for o, k in zip(old, pk)]))
    return gone.distinct()
