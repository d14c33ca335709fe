"""Embedding of chunks: providers, token-aware batches, classified retries, and the operator over a DataFrame."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

from vecloom import config as C
from vecloom.operators import errors as E

ATTEMPTS, LONGEST_WAIT = 3, 10.0
CONNECT_S = 30
#: Models with a known context, in tokens.
CONTEXT = {m: 8191 for m in ("text-embedding-3-small", "text-embedding-3-large", "text-embedding-ada-002")}
REQUEST_INPUTS, REQUEST_TOKENS = 2048, 300_000


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...
    def decode(self, ids: list[int]) -> str: ...


class Embedder(Protocol):
    """Picklable. ``embed`` gives a vector for each input, in order, or raises EmbeddingError."""

    max_inputs: int | None
    max_tokens: int | None

    def embed(self, inputs: list[str]) -> list[list[float]]: ...


def estimated_tokens(text: str) -> int:
    """A quarter of the UTF-8 bytes, rounded up: what is assumed without a tokenizer."""
    return -(-len(text.encode("utf-8", "surrogatepass")) // 4)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.octet_length(c) * 0.25).cast("bigint")


def truncated(text: str, most: int, tokenizer: Tokenizer | None = None) -> str:
    """The first ``most`` tokens; without a tokenizer, or where it can't decode them, that many times four bytes, cut between characters."""
    if tokenizer is None:
        if estimated_tokens(text) <= most:
            return text
    else:
        ids = tokenizer.encode(text)
        if len(ids) <= most:
            return text
        try:
            return tokenizer.decode(ids[:most])
        except (ValueError, UnicodeDecodeError):
            pass
    return text.encode("utf-8", "surrogatepass")[: most * 4].decode("utf-8", "ignore")


def batch_ranges(tokens: Sequence[int], most_inputs: int, most_tokens: int | None = None) -> list[tuple[int, int]]:
    """[start, end) of the requests: each as full as both limits allow."""
    out, start, total = [], 0, 0
    for i, n in enumerate(tokens):
        if most_tokens is not None and n > most_tokens:
            raise E.EmbeddingError(f"a chunk of {n} tokens is longer than a request may be ({most_tokens})", False)
        if i > start and (i - start >= most_inputs or most_tokens is not None and total + n > most_tokens):
            out.append((start, i))
            start, total = i, 0
        total += n
    return [*out, (start, len(tokens))] if len(tokens) else out


def with_retry(call: Callable[[], list[list[float]]], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> tuple[list[list[float]], int]:
    """The result and the attempts it took. Only transient errors are tried again, after 1, 2, ... seconds; the last error has its attempts as ``attempts``."""
    for k in range(1, attempts + 1):
        try:
            return call(), k
        except E.EmbeddingError as e:
            if not e.transient or k == attempts:
                e.attempts = k
                raise
            sleep(min(2.0 ** (k - 1), LONGEST_WAIT))
    raise AssertionError("at least one attempt is made")


# providers ----------------------------------------------------------------------------------------------------


@dataclass
class FunctionEmbedder:
    """A function of one text."""

    function: Callable[[str], Sequence[float]]
    max_inputs: int | None = None
    max_tokens: int | None = None

    def embed(self, inputs: list[str]) -> list[list[float]]:
        return [[float(x) for x in self.function(t)] for t in inputs]


def keyword_embedder(*groups: Sequence[str]) -> FunctionEmbedder:
    """How often the words of each group occur in a text."""
    lowered = [tuple(w.lower() for w in g) for g in groups]
    return FunctionEmbedder(lambda t: [float(sum(t.lower().count(w) for w in g)) for g in lowered])


def letter_embedder(letters: str = "etaoin") -> FunctionEmbedder:
    return FunctionEmbedder(lambda t: [float(t.count(c)) for c in letters])


def hash_embedder(dimensions: int = 64) -> FunctionEmbedder:
    """Signed word counts in hashed places: depends on nothing but the text."""

    def of(text: str) -> list[float]:
        out = [0.0] * dimensions
        for word in text.lower().split():
            h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
            out[h % dimensions] += 1.0 if h >> 31 else -1.0
        return out

    return FunctionEmbedder(of)


def _posted(url: str, body: dict, headers: dict[str, str] | None = None) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(request, timeout=CONNECT_S) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        raise E.from_response(e.code, e.read().decode("utf-8", "replace")) from e
    except (urllib.error.URLError, OSError) as e:
        raise E.EmbeddingError(f"connection failed: {e}", True) from e
    except ValueError as e:
        raise E.EmbeddingError(f"the answer is no JSON: {e}", True) from e


@dataclass
class OpenAIEmbedder:
    model: str
    api_key: str = field(repr=False)
    dimensions: int | None = None
    base_url: str | None = None
    tokenizer: Tokenizer | None = None
    max_inputs: int | None = REQUEST_INPUTS
    max_tokens: int | None = REQUEST_TOKENS

    def embed(self, inputs: list[str]) -> list[list[float]]:
        context = CONTEXT.get(self.model)
        said = [truncated(t, context, self.tokenizer) for t in inputs] if context else inputs
        body = {"model": self.model, "input": said} | ({"dimensions": self.dimensions} if self.dimensions else {})
        answer = _posted(f"{(self.base_url or 'https://api.openai.com/v1').rstrip('/')}/embeddings", body, {"Authorization": f"Bearer {self.api_key}"})
        return [x["embedding"] for x in answer["data"]]


def ollama_url(base_url: str | None) -> str:
    """Scheme, host and port; the port is 11434 where none is given."""
    parts = urlsplit(base_url or os.environ.get("OLLAMA_HOST") or "http://localhost:11434")
    if not parts.scheme or not parts.hostname:
        raise C.ConfigError(f"not a URL with a host: {base_url!r}")
    return f"{parts.scheme}://{parts.hostname}:{parts.port or 11434}"


@dataclass
class OllamaEmbedder:
    """One request for whatever it is given."""

    model: str
    base_url: str | None = None
    context: int | None = None
    tokenizer: Tokenizer | None = None
    max_inputs: int | None = None
    max_tokens: int | None = None

    def __post_init__(self) -> None:
        self.url = ollama_url(self.base_url)

    def embed(self, inputs: list[str]) -> list[list[float]]:
        said = [truncated(t, self.context, self.tokenizer) for t in inputs] if self.context else inputs
        return _posted(f"{self.url}/api/embed", {"model": self.model, "input": said})["embeddings"]


Secrets = Callable[[str], str | None]
_local: dict[str, Embedder] = {}


def register_embedder(name: str, embedder: Embedder) -> None:
    """Makes ``EmbeddingLocal(name)`` mean this one; a name that means another already is refused."""
    if _local.setdefault(name, embedder) is not embedder:
        raise ValueError(f"an embedder {name!r} is registered already")


def api_key(name: str, secrets: Secrets | None = None) -> str:
    """From the environment, else from ``secrets``; that a secret store fails is told apart from there being no key."""
    if name in os.environ:
        return os.environ[name]
    try:
        found = secrets(name) if secrets else None
    except Exception as e:
        raise C.ConfigError(f"failed to resolve API key {name!r} from the secret store: {e}") from e
    if found is None:
        raise C.ConfigError(f"API key {name!r} is neither in the environment nor in the secret store")
    return found


def make_embedder(cfg: C.Part, secrets: Secrets | None = None, tokenizer: Tokenizer | None = None) -> Embedder:
    match cfg:
        case C.EmbeddingOpenAI():
            return OpenAIEmbedder(cfg.model, api_key(cfg.api_key_name, secrets), cfg.dimensions, cfg.base_url, tokenizer)
        case C.EmbeddingOllama():
            return OllamaEmbedder(cfg.model, cfg.base_url, cfg.max_tokens, tokenizer)
        case C.EmbeddingLocal() if cfg.model in _local:
            return _local[cfg.model]
    raise C.ConfigError(f"unknown embedding {getattr(cfg, 'name', None) or getattr(cfg, 'model', None)!r}")


# the operator -------------------------------------------------------------------------------------------------

RESULT = [
    StructField("embedding", ArrayType(FloatType())),
    StructField("error", StringType()),
    StructField("error_class", StringType()),
    StructField("status_code", IntegerType()),
    StructField("error_code", StringType()),
    StructField("attempts", IntegerType()),
]


def embedded(inputs: list[str], embedder: Embedder, dimensions: int | None = None, sleep: Callable[[float], None] = time.sleep) -> list[tuple]:
    """For each input the fields of RESULT; the inputs of a request that fails for good share its error."""
    tokens = [estimated_tokens(t) for t in inputs]
    context = CONTEXT.get(getattr(embedder, "model", ""))
    tokens = [min(n, context) for n in tokens] if context else tokens
    most = embedder.max_tokens
    out: list[tuple] = [(None, f"a chunk of {n} tokens is longer than a request may be ({most})", "permanent", None, None, 0) if most is not None and n > most else () for n in tokens]
    todo = [i for i, x in enumerate(out) if not x]
    for start, end in batch_ranges([tokens[i] for i in todo], embedder.max_inputs or len(inputs) or 1, most):
        part = todo[start:end]
        try:
            vectors, attempts = with_retry(lambda: embedder.embed([inputs[i] for i in part]), sleep=sleep)
            if len(vectors) != len(part):
                raise E.EmbeddingError(f"{len(vectors)} vectors for {len(part)} inputs", False)
            for i, v in zip(part, vectors):
                wrong = dimensions is not None and len(v) != dimensions
                out[i] = (None, f"a vector of {len(v)} dimensions, {dimensions} wanted", "permanent", None, None, attempts) if wrong else (v, None, None, None, None, attempts)
        except E.EmbeddingError as e:
            for i in part:
                out[i] = (None, str(e), e.kind, e.status, e.code, getattr(e, "attempts", 1))
    return out


def embed_chunks(df: DataFrame, embedder: Embedder, chunk: str = "chunk", dimensions: int | None = None) -> DataFrame:
    """``df`` and the fields of RESULT. Failures are rows, not exceptions. The chunk column must not be null.

    Requests are filled from whole Arrow batches, so from many documents. A provider may be called again for rows of a
    task that is run again: write the result before using it more than once.
    """
    schema = StructType([*df.schema.fields, *RESULT])
    at = df.columns.index(chunk)
    kinds = [pa.list_(pa.float32()), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = embedded(batch.column(at).to_pylist(), embedder, dimensions)
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, k) for c, k in zip(columns, kinds)]], schema.names)

    return df.mapInArrow(run, schema)


# vectors ------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))
