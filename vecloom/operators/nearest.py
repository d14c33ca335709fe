"""Exact nearest neighbours of many queries: the base streams past blocks of queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a block, and rows of the base that are compared with it at once.
BLOCK, STEP = 32768, 4096
#: Queries in a tile of similarities: with STEP rows of the base it is some MB.
TILE = 512
#: Cells a core, if there are rows enough: so that the last ones don't keep the others waiting.
CELLS = 3


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of equal length as they are."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths in 64 bits, 1 for a zero vector."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    return np.where(norm == 0, 1.0, norm)


def _true(mask: np.ndarray) -> np.ndarray:
    """Flat places of what is true in a mask that is nearly all false: eight at once."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    at, bit = np.nonzero(flat[:whole].reshape(-1, 8)[eights])
    return np.concatenate([eights[at] * 8 + bit, whole + np.flatnonzero(flat[whole:])])


class _Block:
    """Queries and the ``k`` nearest rows of the base that has passed so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, digits: int) -> None:
        self.ids, self.k, self.digits = ids, k, digits
        self.raw, self.norm = vectors, _norms(vectors)
        self.unit = (vectors / self.norm[:, None]).astype(np.float32)
        #: NaN where no row has passed yet; it sorts last.
        self.near = np.full((len(ids), k), np.nan)
        self.near_ids = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.alike, self.mask = np.empty(TILE * STEP, np.float32), np.empty(TILE * STEP, bool)
        #: How far a similarity in 32 bits may be from the exact one (a sum of products, and both vectors rounded), and half a digit of distance twice.
        self.slack = (vectors.shape[1] + 8) * 2.0**-23 + 2 * 10.0**-digits

    def take(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norm = _norms(vectors)
        unit = (vectors / norm[:, None]).astype(np.float32).T
        odd = not (np.isfinite(norm).all() and np.isfinite(self.norm).all())
        for s in range(0, len(self.ids), TILE):
            tile = slice(s, s + TILE)
            shape = (len(self.unit[tile]), len(ids))
            size = shape[0] * shape[1]
            alike = np.matmul(self.unit[tile], unit, out=self.alike[:size].reshape(shape))
            if odd:
                alike[np.isnan(alike)] = -3
            least = 1 - self.near[tile, -1] - self.slack
            least[np.isnan(least)] = -np.inf  # before k rows have passed
            if len(ids) >= self.k and np.isneginf(least).any():
                at = len(ids) - self.k
                least = np.maximum(least, np.partition(alike, at, axis=1)[:, at].astype(np.float64) - 2 * self.slack)
            # rounded down, so that 32 bits leave nothing out
            found = _true(np.greater_equal(alike, np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None], out=self.mask[:size].reshape(shape)))
            if len(found):
                self._merge(s, *np.divmod(found, len(ids)), ids, vectors, norm)

    def _merge(self, start: int, q: np.ndarray, b: np.ndarray, ids: np.ndarray, vectors: np.ndarray, norm: np.ndarray) -> None:
        """Exact distances of the pairs (q, b); of them and what was kept the k least stay, ties by id."""
        d = np.empty(len(q))
        for s in range(0, len(q), 1 << 16):  # equal vectors may make all pairs candidates
            i, j = q[s : s + (1 << 16)] + start, b[s : s + (1 << 16)]
            d[s : s + (1 << 16)] = 1 - np.einsum("ij,ij->i", self.raw[i] / self.norm[i, None], vectors[j] / norm[j, None])
        d = np.round(d, self.digits) + 0.0
        rows = np.unique(q)
        who = np.concatenate([np.repeat(rows, self.k), q])
        far = np.concatenate([self.near[start + rows].ravel(), d])
        ident = np.concatenate([self.near_ids[start + rows].ravel(), ids[b]])
        order = np.lexsort((ident, far, who))
        first = np.searchsorted(who[order], rows)
        keep = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.near[start + rows] = far[keep].reshape(-1, self.k)
        self.near_ids[start + rows] = ident[keep].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = self.near_ids != np.iinfo(np.int64).max
        return np.repeat(self.ids, there.sum(axis=1)), self.near_ids[there], self.near[there]


def nearest(base: DataFrame, queries: DataFrame, k: int, base_id: str = "vec_id", query_id: str = "vec_id", base_vector: str = "embedding", query_vector: str = "embedding", block: int = BLOCK, digits: int = 9) -> DataFrame:
    """query_id, neighbour_id, distance, rank: the ``k`` rows of ``base`` nearest to each query by cosine, itself included if it is there.

    All pairs are compared. A cell is a block of queries and a part of the base; a task holds the block and k rows a query, and the part streams past,
    so memory doesn't grow with the tables, and what is shuffled is the base once a block of queries, the queries and k rows a query once a part. Similarities in
    32 bits tell which pairs may be among the nearest; only those are worked out in 64.
    Null vectors are left out; all others must have one length. Distances are rounded, ties go by id.
    """
    b = base.where(F.col(f"`{base_vector}`").isNotNull()).select(F.col(f"`{base_id}`").cast("long").alias("id"), F.col(f"`{base_vector}`").cast("array<float>").alias("v"))
    q = queries.where(F.col(f"`{query_vector}`").isNotNull()).select(F.col(f"`{query_id}`").cast("long").alias("id"), F.col(f"`{query_vector}`").cast("array<float>").alias("v"))
    most, cells = q.count(), CELLS * base.sparkSession.sparkContext.defaultParallelism
    nq = max(1, math.ceil(most / block))
    # a part of the base has a block's rows at least, and no more parts than cells are wanted
    nb = max(1, min(math.ceil(cells / nq), math.ceil(b.count() / block)))
    if nb * nq < cells and block == BLOCK:
        nq = max(nq, min(math.ceil(cells / nb), math.ceil(most / STEP)))
    left = q.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    right = b.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    rows = left.select((F.col("q") * nb + F.col("b")).alias("cell"), F.lit(0).alias("kind"), "id", "v").unionByName(right.select((F.col("q") * nb + F.col("b")).alias("cell"), F.lit(1).alias("kind"), "id", "v"))
    schema = pa.schema([("query_id", pa.int64()), ("neighbour_id", pa.int64()), ("distance", pa.float64())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """cell, kind, ids and vectors of stretches of one cell and kind."""
        for batch in batches:
            cell, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(cell)]
            for s, e in zip(cuts, cuts[1:]):
                for at in range(s, e, STEP):
                    n = min(STEP, e - at)
                    yield int(cell[at]), int(kind[at]), batch.column(2).slice(at, n).to_numpy(), _vectors(batch.column(3).slice(at, n))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, held = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held.rows(), schema.types)], schema=schema)

        for cell, kind, ids, vectors in runs(batches):
            if cell != now:
                yield from done()
                now, asked, held = cell, [], None
            if kind == 0:
                asked.append((ids, vectors))
                continue
            if held is None and asked:
                held, asked = _Block(*[np.concatenate(c) for c in zip(*asked)], k, digits), []
            if held is not None:
                held.take(ids, vectors)
        yield from done()

    found = rows.repartitionById(nq * nb, F.col("cell")).sortWithinPartitions("cell", "kind").mapInArrow(join, "query_id long, neighbour_id long, distance double")
    by = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)
