"""The library's functions by name, for SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from vecloom import config as C
from vecloom.operators import embedding as E
from vecloom.operators import text as T

_DOT = "aggregate(zip_with({}, {}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"


def chunks_of(text: str, cfg: C.Part, embed: T.Embed | None = None) -> list[str]:
    """What ``chunk_column`` gives, of one text."""
    match cfg:
        case C.ChunkingCharacter():
            return T.character_chunks(text, cfg.chunk_size, cfg.chunk_overlap, cfg.separator, cfg.is_separator_regex)
        case C.ChunkingRecursive():
            return T.recursive_chunks(text, cfg.chunk_size, cfg.chunk_overlap, cfg.separators, cfg.is_separator_regex)
        case C.ChunkingSentence():
            return T.sentence_chunks(text, cfg.chunk_size, cfg.chunk_overlap, cfg.delimiters, cfg.min_characters_per_sentence, cfg.min_sentences_per_chunk)
        case C.ChunkingSemchunk():
            return T.hierarchy_chunks(text, cfg.chunk_size, cfg.chunk_overlap, cfg.strict_mode)
        case C.ChunkingSemantic():
            return T.semantic_chunks_of(
                [text], embed, cfg.chunk_size, cfg.chunk_overlap, cfg.window_size, cfg.skip_window, cfg.reconnect_similarity_threshold, cfg.max_aside_length, cfg.delimiters, cfg.min_characters_per_sentence
            )[0]
    return [text]


class Chunks:
    """``SELECT * FROM documents, LATERAL chunks(text, '{"implementation": "sentence_chunker"}')``"""

    def eval(self, text: str | None, config: str) -> Iterator[tuple[int, str]]:
        if text is None or not T.trim(text):
            return
        for k, chunk in enumerate(chunks_of(text, C.part_of("chunking", json.loads(config)))):
            yield k, chunk


def _embed_udf(embedder_of):  # noqa: ANN001, ANN202
    """(model, text) -> vector; null for null. Failures are errors, as of any function."""

    def embed(model: pa.Array, text: pa.Array) -> pa.Array:
        said, models = text.to_pylist(), model.to_pylist()
        out: list = [None] * len(said)
        for name in set(models) - {None}:
            todo = [i for i, (m, t) in enumerate(zip(models, said)) if m == name and t is not None]
            rows = E.embedded([said[i] for i in todo], embedder_of(name))
            for i, row in zip(todo, rows):
                if row[1]:
                    raise RuntimeError(row[1])
                out[i] = row[0]
        return pa.array(out, pa.list_(pa.float32()))

    return F.arrow_udf(embed, ArrayType(FloatType()))


def register(spark: SparkSession, secrets: E.Secrets | None = None, base_url: str | None = None) -> None:
    """cosine_similarity, token_estimate, unicode_trim, chunk_text, chunks (a table function), openai_embed and ollama_embed."""
    dot = _DOT.format
    for sql in (
        f"cosine_similarity(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) = size(b) AND {dot('a', 'a')} * {dot('b', 'b')} > 0 "
        f"THEN {dot('a', 'b')} / (sqrt({dot('a', 'a')}) * sqrt({dot('b', 'b')})) ELSE 0D END",
        "token_estimate(t STRING) RETURNS BIGINT RETURN CAST(ceil(octet_length(t) * 0.25) AS BIGINT)",
        r"unicode_trim(t STRING) RETURNS STRING RETURN regexp_replace(t, '^[\\p{IsWhite_Space}]+|[\\p{IsWhite_Space}]+\\z', '')",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {sql}")

    def chunk_text(text: pa.Array, config: pa.Array) -> pa.Array:
        parts = {c: C.part_of("chunking", json.loads(c)) for c in set(config.to_pylist()) - {None}}
        return pa.array([None if t is None or c is None else chunks_of(t, parts[c]) for t, c in zip(text.to_pylist(), config.to_pylist())], pa.list_(pa.string()))

    spark.udf.register("chunk_text", F.arrow_udf(chunk_text, ArrayType(StringType())))
    spark.udtf.register("chunks", F.udtf(Chunks, returnType="chunk_seq int, chunk string"))

    def openai(model: str) -> E.Embedder:
        return E.OpenAIEmbedder(model, E.api_key("OPENAI_API_KEY", secrets), base_url=base_url)

    spark.udf.register("openai_embed", _embed_udf(openai))
    spark.udf.register("ollama_embed", _embed_udf(lambda model: E.OllamaEmbedder(model, base_url)))
