"""Substring dedup by repeated-phrase automata.

Definition: a word of a document is *repeated* when it lies in a run of ``length`` words that
some document with another id holds too, word for word (white space aside). Maximal runs of repeated
words are the passages.

1. Every document gives the hashes of some of its ``seed``-word phrases, those that are smallest among
   ``length - seed + 1`` neighbours (winnowing): two documents that share ``length`` words share a phrase thus chosen.
   A count over all documents confirms which of them recur.
2. Documents with a recurring phrase, no others can hold a passage, are streamed through Aho-Corasick automata
   over words, sharded by documents: each shard holds the recurring phrases of its documents and locates every occurrence.
3. The runs of ``length`` words round the occurrences are hashed and counted over all documents, packed by hash range;
   those of two documents or more are confirmed, and make up the passages.

Word and run hashes have 64 bits; two different runs of one hash would count as equal.

Defined results
* null, empty and blank texts, and texts of fewer than ``length`` words, have no passages;
* rows with a null id have none and make none; rows that repeat an id are one holder, and each has its passages;
* of the holders of a run the smallest id is the first: :func:`passages` says so and :func:`drop_repeats` leaves its copy;
* an empty table gives an empty result; other columns are ignored by :func:`passages` and kept by :func:`drop_repeats`;
* texts are read whole at any length; offsets count characters, the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .frames import discard, large_list, stored, texts, written
from .textbytes import blocks, window_hashes, word_hashes

LENGTH, SEED = 50, 25
#: Phrases in an automaton, about: a node takes some 50 bytes and a phrase has SEED nodes at most.
SHARD_PHRASES = 40_000
#: Different words of a shard that one character each can stand for.
CHARACTERS = 0x10F000
#: Runs in a range of hashes that one task counts, about.
RANGE_RUNS = 400_000


def winnowed(h: np.ndarray, at: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen phrases and their hashes; ``at``: where texts begin among the words, and the end."""
    k = window_hashes(h, seed)
    w = length - seed + 1
    if len(k) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    valid = np.zeros(len(k) - w + 2, np.int32)
    long = np.diff(at) >= length
    np.add.at(valid, at[:-1][long], 1)
    np.add.at(valid, at[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    place = np.unique(start + sliding_window_view(k, w)[start].argmin(axis=1)) if len(start) < len(k) // 4 else np.unique((np.arange(len(k) - w + 1) + sliding_window_view(k, w).argmin(axis=1))[start])
    return place, k[place]


def _seed_batches(length: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, data, off in blocks(batch.column(1)):
                h, _, _, at = word_hashes(data, off)
                place, k = winnowed(h, at, length, seed)
                doc = np.searchsorted(at, place, "right") - 1
                pair = np.unique(np.stack([doc.astype(np.uint64), k], axis=1), axis=0) if len(k) else np.zeros((0, 2), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + pair[:, 0].astype(np.int64)]), pa.array(np.ascontiguousarray(pair[:, 1]).view(np.int64))], ["doc_id", "seed"])

    return seeds


def occurrences(h: np.ndarray, at: np.ndarray, k: np.ndarray, wanted: list[np.ndarray], seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text, places) of every occurrence of a recurring phrase, by automata over words.

    h: words of the texts, k: hashes of their phrases, wanted: the recurring phrases of each text. A word is a character,
    or two, of which the first is never a second one, where there are more words than characters.
    """
    words, code = np.unique(h, return_inverse=True)
    width = 1 if len(words) <= CHARACTERS else 2
    if width == 1:
        code = code + 0x20
        code[code >= 0xD800] += 0x800  # no surrogates
    else:
        code = np.stack([0x20 + (code >> 15), 0x10000 + (code & 0x7FFF)], 1).ravel()
    text = code.astype("<u4").tobytes().decode("utf-32-le")
    n, doc = len(at) - 1, 0
    while doc < n:
        first, phrases = doc, {}
        while doc < n and (doc == first or len(phrases) < SHARD_PHRASES):
            lo, hi = int(at[doc]), int(at[doc + 1]) - seed + 1
            for p in (np.flatnonzero(np.isin(k[lo:hi], wanted[doc])) + lo if hi > lo else ()):
                phrases[text[width * p : width * (p + seed)]] = None
            doc += 1
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for phrase in phrases:
            automaton.add_word(phrase)
        if not phrases:
            continue
        automaton.make_automaton()
        for d in range(first, doc):
            lo = int(at[d])
            hits = [end // width - seed + 1 for end, _ in automaton.iter(text[width * lo : width * int(at[d + 1])])]
            if hits:
                yield d, lo + np.array(hits, np.int64)


def _run_batches(length: int, seed: int, ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(range, load) with load = rows of (hash, doc_id, place in the document)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, data, off in blocks(batch.column(1)):
                h, _, _, at = word_hashes(data, off)
                k, run = window_hashes(h, seed), window_hashes(h, length)
                wanted = [np.asarray(x, np.int64).view(np.uint64) for x in batch.column(2).slice(i, len(off) - 1).to_pylist()]
                out = []
                for d, place in occurrences(h, at, k, wanted, seed):
                    lo, hi = int(at[d]), int(at[d + 1]) - length + 1
                    if hi <= lo:
                        continue
                    near = np.zeros(hi - lo + 1, np.int32)
                    np.add.at(near, np.maximum(place - (length - seed), lo).clip(max=hi) - lo, 1)
                    np.add.at(near, np.minimum(place + 1, hi) - lo, -1)
                    start = np.flatnonzero(np.cumsum(near[:-1]) > 0) + lo
                    out.append(np.column_stack([run[start].view(np.int64), np.full(len(start), ids[i + d]), start - lo]))
                if not out:
                    continue
                rows = np.concatenate(out)
                to = (rows[:, 0].view(np.uint64) % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                rows, to = rows[order], to[order]
                cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                load = [_packed(rows[s:e]) for s, e in zip(cut, [*cut[1:], len(rows)])]
                yield pa.RecordBatch.from_arrays([pa.array(to[cut]), pa.array(load, pa.binary())], ["range", "load"])

    return runs


def _packed(rows: np.ndarray) -> bytes:
    """Hashes as they are, runs of equal ids as (id, length), places in 32 bits."""
    first = np.flatnonzero(np.r_[True, rows[1:, 1] != rows[:-1, 1]])
    head = np.array([len(rows), len(first)], np.int64)
    size = np.diff(np.r_[first, len(rows)])
    return b"".join(x.tobytes() for x in (head, rows[:, 0], rows[first, 1], size, rows[:, 2].astype(np.int32)))


def _unpacked(load: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(load, np.int64, 2)
    h, who, size = np.frombuffer(load, np.int64, n, 16), np.frombuffer(load, np.int64, m, 16 + 8 * n), np.frombuffer(load, np.int64, m, 16 + 8 * (n + m))
    return h, np.repeat(who, size), np.frombuffer(load, np.int32, n, 16 + 8 * (n + 2 * m))


def _confirm(table: pa.Table) -> pa.Table:
    """Of one range: doc_id and the places of its runs that others hold too, as 2 * place + (is first)."""
    h, doc, place = (np.concatenate(x) for x in zip(*(_unpacked(x.as_py()) for x in table["load"])))
    order = np.lexsort((doc, h))
    h, doc, place = h[order], doc[order], place[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[first, len(h)])
    shared = np.repeat(doc[first] != doc[np.r_[first[1:], len(h)] - 1], size)
    mark = (2 * place + (doc == np.repeat(doc[first], size)))[shared]
    doc = doc[shared]
    order = np.argsort(doc, kind="stable")
    doc, mark = doc[order], mark[order]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    return pa.table({"doc_id": pa.array(doc[first], pa.int64()), "marks": large_list(mark, np.diff(np.r_[first, len(doc)]), pa.int64())})


def word_marks(marks: np.ndarray, n: int, length: int) -> np.ndarray:
    """For each of n words: 0 not repeated, 1 in runs that this document holds first and no others, 2 in a run that another does."""
    out = np.zeros(n, np.int8)
    for bit, value in ((1, 1), (0, 2)):
        p = marks[marks % 2 == bit] // 2
        p = p[p + length <= n]
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, p, 1)
        np.add.at(edge, p + length, -1)
        out[np.cumsum(edge[:-1]) > 0] = value
    return out


def _spans(column: pa.Array, marks: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first words, word counts, start and end bytes, whether held first) of the passages of each text that has any."""
    lists = marks.to_pylist()
    for i, data, off in blocks(column):
        _, starts, ends, at = word_hashes(data, off)
        for d in range(len(off) - 1):
            if not lists[i + d]:
                continue
            lo, hi = at[d], at[d + 1]
            m = word_marks(np.asarray(lists[i + d], np.int64), hi - lo, length)
            edge = np.flatnonzero(np.r_[True, m[1:] != m[:-1]]) if len(m) else np.zeros(0, np.int64)
            last = np.r_[edge[1:], len(m)] - 1
            some = m[edge] > 0
            edge, last = edge[some], last[some]
            b, e = starts[lo + edge] - off[d], ends[lo + last] - off[d]
            lead = np.r_[0, np.cumsum((data[off[d] : off[d + 1]] & 0xC0) != 0x80)]
            yield i + d, last - edge + 1, lead[b], lead[e], m[edge] == 1


def _passage_batches(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(np.full(len(n), d), b, e, n, f) for d, n, b, e, f in _spans(batch.column(1), batch.column(2), length)]
            d, b, e, n, f = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(b), pa.array(e), pa.array(n), pa.array(f.astype(bool))], ["doc_id", "start", "end", "n_words", "is_first"])

    return out


def _held(rows: DataFrame, length: int, seed: int) -> tuple[DataFrame, str]:
    """Documents with a recurring phrase (doc_id, text, seeds), written; and the path of a table that is needed no more."""
    chosen, path = stored(rows.mapInArrow(_seed_batches(length, seed), "doc_id long, seed long"))
    # a phrase of very many documents is counted before it is moved, and a join, unlike a window, may be split where one is frequent
    recurring = chosen.groupBy("seed").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("seed")
    wanted = chosen.join(recurring, "seed", "left_semi").groupBy("doc_id").agg(F.collect_set("seed").alias("seeds"))
    return written(rows.join(wanted, "doc_id")), path


def _marks(rows: DataFrame, length: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Documents with a recurring phrase (doc_id, text), written; and doc_id, marks of those with passages."""
    held, path = _held(rows, length, seed)
    discard(rows.sparkSession, path)
    total = held.agg(F.sum(F.size("seeds"))).first()[0] or 0
    ranges = max(1, total * 13 // RANGE_RUNS)
    runs = held.mapInArrow(_run_batches(length, seed, ranges), "range long, load binary")
    confirmed = runs.repartition(ranges, "range").groupBy("range").applyInArrow(_confirm, "doc_id long, marks array<long>")
    return held, confirmed.groupBy("doc_id").agg(F.flatten(F.collect_list("marks")).alias("marks"))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, start, end, n_words, is_first: every passage of every document.

    is_first: this document is the first holder of all runs in it; else another is of one at least.
    """
    rows = texts(docs, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL")
    held, marks = _marks(rows, length, seed)
    joined = held.select("doc_id", "text").join(marks, "doc_id")
    return joined.mapInArrow(_passage_batches(length), "doc_id long, start long, end long, n_words long, is_first boolean")


def _without(text: pa.Array, marks: pa.Array, length: int) -> pa.Array:
    out = text.to_pylist()
    for d, _, starts, ends, first in _spans(text, marks, length):
        parts, done = [], 0
        for b, e, keep in zip(starts.tolist(), ends.tolist(), first.tolist()):
            if not keep:
                parts.append(out[d][done:b])
                done = e
        out[d] = "".join([*parts, out[d][done:]]).strip()
    return pa.array(out, pa.string())


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``docs`` with every passage left in its first holder only; documents of which nothing is left go."""
    rows = texts(docs, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL")
    _, marks = _marks(rows, length, seed)
    # the two columns go by names that no column of docs has
    held, mark = _free(docs, "held"), _free(docs, "marks")
    marks = marks.where(F.exists("marks", lambda m: m % 2 == 0)).select(F.col("doc_id").alias(held), F.col("marks").alias(mark))
    joined = docs.join(marks, docs[f"`{id_col}`"].cast("long") == marks[held], "left")

    def without(text: pa.Array, marks: pa.Array) -> pa.Array:
        return _without(text, marks, length)

    cut = F.arrow_udf(without, StringType())(F.col(f"`{text_col}`").cast("string"), F.col(mark))
    # only texts that lose something go to Python
    text = F.when(F.col(held).isNotNull(), cut).otherwise(F.col(f"`{text_col}`").cast("string"))
    return joined.withColumn(text_col, text).where(F.col(held).isNull() | (F.length(F.col(f"`{text_col}`")) > 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _free(df: DataFrame, name: str) -> str:
    """``name``, with as many signs before it as make it new."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name
