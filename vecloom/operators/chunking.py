"""Chunkers as columns: text -> array of chunks, in order.

Whole text, literal single-separator and sentence chunking are folds over arrays in the JVM; recursive, pattern and
hierarchy chunking recurse and are Arrow UDFs. All give what ``operators.text`` gives, null for null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from vecloom import config as C
from vecloom.operators import text as T

_WHITE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_EDGES = f"^{_WHITE}|{_WHITE}$".replace("$", r"\z")


def unicode_trim(c: Column) -> Column:
    """Without Unicode white space at either end (``trim`` knows only blanks)."""
    return F.regexp_replace(c, _EDGES, "")


def is_blank(c: Column) -> Column:
    """Whether null, empty or white space only."""
    return c.isNull() | ~c.rlike(_WHITE.replace("[", "[^", 1).rstrip("+"))


def quoted(s: str) -> str:
    """A literal for a Java pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)


def chunk_none(c: Column) -> Column:
    return F.array(c)


def sentences(c: Column, delimiters: Sequence[str] = T.DELIMITERS) -> Column:
    pattern = "(?s).*?(?:" + "|".join(quoted(d) for d in delimiters) + ")|.+\\z"
    return F.filter(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda s: s != "")


def merge_short(parts: Column, least: int) -> Column:
    """Sentences of ``least`` characters at least: cut after each point where that many have gathered."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(acc: Column, part: Column) -> Column:
        held = F.concat(acc["held"], part)
        full = F.length(held) >= least
        return F.struct(F.when(full, F.concat(acc["out"], F.array(held))).otherwise(acc["out"]).alias("out"), F.when(full, F.lit("")).otherwise(held).alias("held"))

    def finish(acc: Column) -> Column:
        n = F.size(acc["out"])
        last = F.concat(F.slice(acc["out"], 1, n - 1), F.array(F.concat(F.element_at(acc["out"], -1), acc["held"])))
        return F.when(acc["held"] == "", acc["out"]).when(n == 0, F.array(acc["held"])).otherwise(last)

    return F.aggregate(parts, start, step, finish)


def _sums(parts: Column, gap: int = 0) -> Column:
    """0 and the running sums of lengths, ``gap`` added to each."""
    return F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p) + gap)))


def _with_sums(parts: Column, gap: int, then: Callable[[Column, Column], Column]) -> Column:
    """``then(parts, sums)`` with both evaluated once: a one-element array carries them through a lambda."""
    both = F.transform(F.array(parts), lambda p: F.struct(p.alias("p"), _sums(p, gap).alias("t")))
    return F.element_at(F.transform(both, lambda x: then(x["p"], x["t"])), 1)


def _chunks(parts: Column, gap: str, overflow: Callable[[Column, Column], Column], restart: Callable[[Column, Column], Column], strip: bool, drop: bool) -> Column:
    n = F.size(parts)
    ranges = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: Column, i: Column) -> Column:
        full = (i > acc["s"]) & overflow(acc, i)
        emitted = F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), i.alias("e"))))
        return F.struct(F.when(full, emitted).otherwise(acc["out"]).alias("out"), F.when(full, restart(acc, i)).otherwise(acc["s"]).alias("s"))

    many = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    found = F.aggregate(
        many,
        F.struct(ranges.alias("out"), F.lit(0).alias("s")),
        step,
        lambda acc: F.when(n > acc["s"], F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), n.alias("e"))))).otherwise(acc["out"]),
    )
    joined = F.transform(found, lambda r: F.array_join(F.slice(parts, r["s"] + 1, r["e"] - r["s"]), gap))
    if strip:
        joined = F.transform(joined, unicode_trim)
    return F.filter(joined, lambda x: x != "") if drop else joined


def pack(parts: Column, size: int, overlap: int, least: int = 1, strip: bool = True, drop_empty: bool = False) -> Column:
    """Greedy packing of non-empty sentences; see ``text.pack``."""

    def then(p: Column, t: Column) -> Column:
        def total(a: Column, b: Column) -> Column:
            return F.element_at(t, b + 1) - F.element_at(t, a + 1)

        def restart(acc: Column, i: Column) -> Column:
            if not overlap:
                return i
            near = F.sequence(F.greatest(F.lit(0), i - overlap), i)
            return F.element_at(F.filter(near, lambda s: total(s, i) <= overlap), 1)

        return _chunks(p, "", lambda acc, i: (total(acc["s"], i + 1) > size) & (i - acc["s"] >= least), restart, strip, drop_empty)

    return _with_sums(parts, 0, then)


def merge_splits(parts: Column, sep: str, size: int, overlap: int, strip: bool = True) -> Column:
    """See ``text.merge_splits``, for non-empty parts and lengths in characters."""
    gap = len(sep)

    def then(p: Column, t: Column) -> Column:
        def total(a: Column, b: Column) -> Column:  # of parts a..b-1 joined
            return F.greatest(F.element_at(t, b + 1) - F.element_at(t, a + 1) - gap, F.lit(0))

        def restart(acc: Column, i: Column) -> Column:
            n = F.element_at(t, i + 2) - F.element_at(t, i + 1) - gap
            fits = lambda s: (s == i) | ((total(s, i) <= overlap) & (total(s, i) + n + gap <= size))
            return F.element_at(F.filter(F.sequence(F.greatest(acc["s"], i - overlap - 1), i), fits), 1)

        return _chunks(p, sep, lambda acc, i: total(acc["s"], i + 1) > size, restart, strip, True)

    return _with_sums(parts, gap, then)


def chunk_sentence(c: Column, size: int = 800, overlap: int = 400, delimiters: Sequence[str] = T.DELIMITERS, min_chars: int = 12, min_sentences: int = 1) -> Column:
    return F.when(c.isNotNull(), pack(merge_short(sentences(c, delimiters), min_chars), size, overlap, min_sentences))


def chunk_character(c: Column, size: int = 800, overlap: int = 400, separator: str = "\n\n", regex: bool = False) -> Column:
    if regex or not separator:
        return _python(lambda t: T.character_chunks(t, size, overlap, separator, regex))(c)
    parts = F.filter(F.split(c, quoted(separator), -1), lambda p: p != "")
    return F.when(c.isNotNull(), merge_splits(parts, separator, size, overlap))


def _python(chunker: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    def chunks(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else chunker(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(chunks, ArrayType(StringType()))


def chunk_recursive(c: Column, size: int = 800, overlap: int = 400, separators: Sequence[str] = C.RECURSIVE_SEPARATORS, regex: bool = False) -> Column:
    separators = tuple(separators)
    return _python(lambda t: T.recursive_chunks(t, size, overlap, separators, regex))(c)


def chunk_semchunk(c: Column, size: int = 800, overlap: int = 400, strict: bool = False, length: T.Length = len) -> Column:
    return _python(lambda t: T.hierarchy_chunks(t, size, overlap, strict, True, length))(c)


def chunk_semantic(c: Column, embed: T.Embed | None, cfg: C.ChunkingSemantic = C.ChunkingSemantic()) -> Column:
    """Embedding boundaries; the windows of all texts of an Arrow batch share calls of ``embed``."""

    def chunks(texts: pa.Array) -> pa.Array:
        said = texts.to_pylist()
        out = T.semantic_chunks_of(
            said, embed, cfg.chunk_size, cfg.chunk_overlap, cfg.window_size, cfg.skip_window, cfg.reconnect_similarity_threshold, cfg.max_aside_length, cfg.delimiters, cfg.min_characters_per_sentence
        )
        return pa.array([None if t is None else x for t, x in zip(said, out)], pa.list_(pa.string()))

    return F.arrow_udf(chunks, ArrayType(StringType()))(c)


def chunk_column(c: Column, cfg: C.Part, embed: T.Embed | None = None) -> Column:
    """The chunker that a configuration names."""
    match cfg:
        case C.ChunkingCharacter():
            return chunk_character(c, cfg.chunk_size, cfg.chunk_overlap, cfg.separator, cfg.is_separator_regex)
        case C.ChunkingRecursive():
            return chunk_recursive(c, cfg.chunk_size, cfg.chunk_overlap, cfg.separators, cfg.is_separator_regex)
        case C.ChunkingSentence():
            return chunk_sentence(c, cfg.chunk_size, cfg.chunk_overlap, cfg.delimiters, cfg.min_characters_per_sentence, cfg.min_sentences_per_chunk)
        case C.ChunkingSemchunk():
            return chunk_semchunk(c, cfg.chunk_size, cfg.chunk_overlap, cfg.strict_mode)
        case C.ChunkingSemantic():
            return chunk_semantic(c, embed, cfg)
    return chunk_none(c)


def explode_chunks(df: DataFrame, chunks: Column) -> DataFrame:
    """A row per chunk: the columns of ``df``, chunk_seq from 0, chunk."""
    return df.select("*", F.posexplode(chunks).alias("chunk_seq", "chunk"))
