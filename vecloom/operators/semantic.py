"""Embedding boundaries: as SQL windows over a table of sentences, or text by text where sentences needn't be moved."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators import text as T
from vecloom.operators.chunking import merge_short, sentences
from vecloom.operators.embedding import cosine_similarity
from vecloom.operators.text import DELIMITERS


def sentence_rows(df: DataFrame, key: str, text: str, delimiters: Sequence[str] = DELIMITERS, min_chars: int = 12) -> DataFrame:
    """key, pos, sentence."""
    return df.select(F.col(f"`{key}`").alias(key), F.posexplode(merge_short(sentences(F.col(f"`{text}`"), delimiters), min_chars)).alias("pos", "sentence"))


def sentence_windows(rows: DataFrame, key: str, width: int = 3) -> DataFrame:
    """key, pos, n_sentences, window: ``width`` sentences from each place on, where there are as many."""
    by = Window.partitionBy(key)
    ahead = by.orderBy("pos").rowsBetween(0, width - 1)
    out = rows.select(key, "pos", F.count("*").over(by).alias("n_sentences"), F.array_join(F.collect_list("sentence").over(ahead), "").alias("window"))
    return out.where(F.col("pos") <= F.col("n_sentences") - width)


def similarities(windows: DataFrame, key: str, embedding: Column) -> DataFrame:
    """key, pos, n_sentences, similarity of each window and the next."""
    order = Window.partitionBy(key).orderBy("pos")
    with_vector = windows.select(key, "pos", "n_sentences", embedding.alias("v"))
    paired = with_vector.withColumn("w", F.lead("v").over(order)).where("w IS NOT NULL")
    return paired.select(key, "pos", "n_sentences", cosine_similarity(F.col("v"), F.col("w")).alias("similarity"))


def smoothed(rows: DataFrame, key: str, digits: int | None = 9) -> DataFrame:
    """... and ``smooth``: Savitzky-Golay, five points; two values at each end stay. Rounded, so that equal stretches are equal."""
    order = Window.partitionBy(key).orderBy("pos")
    s = F.col("similarity")
    near = [F.lag(s, 2).over(order), F.lag(s, 1).over(order), s, F.lead(s, 1).over(order), F.lead(s, 2).over(order)]
    total = (F.lit(-3.0) * near[0] + F.lit(12.0) * near[1] + F.lit(17.0) * near[2] + F.lit(12.0) * near[3] - F.lit(3.0) * near[4]) / F.lit(35.0)
    value = F.coalesce(total, s)
    return rows.withColumn("smooth", F.round(value, digits) if digits is not None else value)


def boundaries(rows: DataFrame, key: str, width: int = 3) -> DataFrame:
    """key, boundary: numbers of the sentences before which a chunk ends."""
    order = Window.partitionBy(key).orderBy("pos")
    low = rows.select(key, "pos", "n_sentences", "smooth", F.lag("smooth").over(order).alias("a"), F.lead("smooth").over(order).alias("b")).where("smooth < a AND smooth <= b")
    return low.select(key, (F.col("pos") + width).alias("boundary"), "n_sentences").where("boundary > 0 AND boundary < n_sentences").drop("n_sentences")


# text by text ---------------------------------------------------------------------------------------------------


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    return np.where(np.abs(y - whole) >= 0.5, whole + np.sign(y), whole) / 10.0**digits


def _dips(vectors: np.ndarray, starts: np.ndarray, digits: int) -> np.ndarray:
    """Places i of ``vectors`` for which the smoothed similarity of i and i + 1 is a local minimum within its text; texts begin at ``starts``.

    What ``similarities``, ``smoothed`` and ``boundaries`` do, over the windows of many texts at once.
    """
    n = len(vectors)
    v, w = vectors[:-1], vectors[1:]

    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        for k in range(a.shape[1]):  # in the order of the SQL's sum
            total += a[:, k] * b[:, k]
        return total

    norm = np.sqrt(dot(v, v)) * np.sqrt(dot(w, w))
    y = np.divide(dot(v, w), norm, out=np.zeros(n - 1), where=norm > 0)
    # a pair belongs to the text of its first window, and is none if its second is of another
    text = np.zeros(n, np.int64)
    np.add.at(text, starts[starts < n], 1)
    text = np.cumsum(text)
    pair = text[:-1] == text[1:]
    owner = np.where(pair, text[:-1], -1)
    z = y.copy()
    if n > 5:
        inner = (owner[:-4] == owner[4:]) & pair[2:-2] & (owner[:-4] >= 0)
        total = (-3.0 * y[:-4] + 12.0 * y[1:-3] + 17.0 * y[2:-2] + 12.0 * y[3:-1] - 3.0 * y[4:]) / 35.0
        z[2:-2] = np.where(inner, total, y[2:-2])
    z = _rounded(z, digits)
    if n < 4:
        return np.zeros(0, np.int64)
    same = (owner[:-2] == owner[1:-1]) & (owner[1:-1] == owner[2:]) & (owner[1:-1] >= 0)
    return np.flatnonzero(same & (z[1:-1] < z[:-2]) & (z[1:-1] <= z[2:])) + 1


#: Characters of the texts whose windows are worked on at once.
AT_ONCE = 1 << 21


def bounded(texts: Sequence[str | None], embed: T.Embed, width: int = 3, delimiters: Sequence[str] = DELIMITERS, min_chars: int = 12, digits: int = 9) -> list[tuple[list[str], list[int]]]:
    """Of each text its sentences, and the numbers of those before which a chunk ends."""
    parts = [T.merge_short(T.sentences(t, delimiters), min_chars) if t else [] for t in texts]
    counts = np.array([max(0, len(p) - width + 1) for p in parts], np.int64)
    starts = np.cumsum(counts) - counts
    out: list[tuple[list[str], list[int]]] = [(p, []) for p in parts]
    if counts.sum() > 3:
        windows = [w for p in parts for w in T.sentence_windows(p, width)]
        vectors = np.asarray(embed(windows), np.float32).astype(np.float64)
        filled = np.flatnonzero(counts)
        for i in _dips(vectors, starts[filled], digits).tolist():
            at = filled[np.searchsorted(starts[filled], i, "right") - 1]
            out[at][1].append(i - int(starts[at]) + width)
    return [(p, [b for b in bounds if 0 < b < len(p)]) for p, bounds in out]


def _stretches(texts: Sequence[str | None]) -> list[slice]:
    """Runs of texts of about AT_ONCE characters."""
    cuts, held = [0], 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > AT_ONCE:
            cuts.append(i)
            held = 0
        held += len(t or "")
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(texts)])]


def boundary_lists(text: Column, embed: T.Embed, width: int = 3) -> Column:
    """The boundaries of each text: nothing is shuffled."""

    def run(texts: pa.Array) -> pa.Array:
        said = texts.to_pylist()
        return pa.array([b for s in _stretches(said) for _, b in bounded(said[s], embed, width)], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def chunk_lists(text: Column, embed: T.Embed, width: int = 3) -> Column:
    """The chunks of each text, joined between boundaries, trimmed, without empty ones: nothing is shuffled."""

    def run(texts: pa.Array) -> pa.Array:
        said = texts.to_pylist()
        return pa.array([T.cut_at(p, b) for s in _stretches(said) for p, b in bounded(said[s], embed, width)], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


def semantic_rows(df: DataFrame, key: str, text: str, embed: T.Embed, width: int = 3) -> DataFrame:
    """key, chunk_seq, chunk; a row of ``df`` is a text of its own."""
    return df.select(F.col(f"`{key}`").alias(key), F.posexplode(chunk_lists(F.col(f"`{text}`"), embed, width)).alias("chunk_seq", "chunk"))
