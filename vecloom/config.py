"""Configuration of a vectorizer: frozen dataclasses, kept as JSON.

Reading is open-world. Unknown fields are ignored; an unknown chunking counts as none, an unknown
formatting as the chunk itself, an unknown embedding or loading fails only when it is used, and an unknown
destination fails at once. Sizes must not be negative. Fields that are None aren't written.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from typing import Any

RECURSIVE_SEPARATORS = ("\n\n", "\n", ".", "?", "!", " ", "")
SENTENCE_DELIMITERS = (". ", "! ", "? ", "\n")


class ConfigError(ValueError):
    """A configuration that can't be read or run."""


@dataclass(frozen=True)
class Part:
    """One section; subclasses set ``implementation`` and ``config_type``."""

    def to_dict(self) -> dict[str, Any]:
        own = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items() if v is not None}
        return {"implementation": IMPLEMENTATIONS[type(self)][1], "config_type": IMPLEMENTATIONS[type(self)][0], **own}

    @classmethod
    def of(cls, said: dict[str, Any]) -> Part:
        known = {f.name: f for f in fields(cls)}
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in said.items() if k in known and v is not None}
        for k, v in values.items():
            if isinstance(v, int) and v < 0:
                raise ConfigError(f"{k} must not be negative")
        return cls(**values)


@dataclass(frozen=True)
class LoadingColumn(Part):
    column_name: str
    retries: int = 6


@dataclass(frozen=True)
class EmbeddingOpenAI(Part):
    model: str
    dimensions: int | None = None
    user: str | None = None
    api_key_name: str = "OPENAI_API_KEY"
    base_url: str | None = None


@dataclass(frozen=True)
class EmbeddingOllama(Part):
    model: str
    dimensions: int | None = None
    base_url: str | None = None
    options: dict | None = None
    keep_alive: str | None = None
    max_tokens: int | None = None


@dataclass(frozen=True)
class EmbeddingLocal(Part):
    """An embedder registered under a name in this process and its executors; for tests and own models."""

    model: str
    dimensions: int


@dataclass(frozen=True)
class ChunkingNone(Part):
    pass


@dataclass(frozen=True)
class ChunkingCharacter(Part):
    chunk_size: int = 800
    chunk_overlap: int = 400
    separator: str = "\n\n"
    is_separator_regex: bool = False


@dataclass(frozen=True)
class ChunkingRecursive(Part):
    chunk_size: int = 800
    chunk_overlap: int = 400
    separators: tuple[str, ...] = RECURSIVE_SEPARATORS
    is_separator_regex: bool = False


@dataclass(frozen=True)
class ChunkingSentence(Part):
    chunk_size: int = 800
    chunk_overlap: int = 400
    delimiters: tuple[str, ...] = SENTENCE_DELIMITERS
    min_characters_per_sentence: int = 12
    min_sentences_per_chunk: int = 1


@dataclass(frozen=True)
class ChunkingSemchunk(Part):
    chunk_size: int = 800
    chunk_overlap: int = 400
    memoize: bool = True
    strict_mode: bool = False


@dataclass(frozen=True)
class ChunkingSemantic(Part):
    chunk_size: int = 800
    chunk_overlap: int = 400
    window_size: int = 3
    skip_window: int = 0
    reconnect_similarity_threshold: float = 0.75
    max_aside_length: int = 512
    delimiters: tuple[str, ...] = SENTENCE_DELIMITERS
    min_characters_per_sentence: int = 12


@dataclass(frozen=True)
class FormattingTemplate(Part):
    template: str = "$chunk"


@dataclass(frozen=True)
class FormattingChunk(Part):
    pass


@dataclass(frozen=True)
class DestinationTable(Part):
    target_schema: str | None = None
    target_table: str | None = None
    view_schema: str | None = None
    view_name: str | None = None


@dataclass(frozen=True)
class DestinationColumn(Part):
    embedding_column: str


@dataclass(frozen=True)
class Processing(Part):
    batch_size: int | None = None
    concurrency: int | None = None

    @property
    def executors(self) -> int:
        return min(10, max(1, self.concurrency or 1))

    @property
    def rows(self) -> int:
        return self.batch_size or 50


@dataclass(frozen=True)
class Unknown(Part):
    """An implementation of no known name; fails when it is used."""

    name: str = ""


IMPLEMENTATIONS: dict[type, tuple[str, str]] = {
    LoadingColumn: ("loading", "column"),
    EmbeddingOpenAI: ("embedding", "openai"),
    EmbeddingOllama: ("embedding", "ollama"),
    EmbeddingLocal: ("embedding", "local"),
    ChunkingNone: ("chunking", "none"),
    ChunkingCharacter: ("chunking", "character_text_splitter"),
    ChunkingRecursive: ("chunking", "recursive_character_text_splitter"),
    ChunkingSentence: ("chunking", "sentence_chunker"),
    ChunkingSemchunk: ("chunking", "semchunk"),
    ChunkingSemantic: ("chunking", "semantic_chunker"),
    FormattingTemplate: ("formatting", "python_template"),
    FormattingChunk: ("formatting", "chunk_value"),
    DestinationTable: ("destination", "table"),
    DestinationColumn: ("destination", "column"),
    Processing: ("processing", "default"),
    Unknown: ("unknown", "unknown"),
}
_BY_NAME = {v: k for k, v in IMPLEMENTATIONS.items()}
_OTHERWISE = {"chunking": ChunkingNone(), "formatting": FormattingChunk(), "processing": Processing()}


def part_of(section: str, said: dict[str, Any] | None) -> Part:
    """A section from JSON, by the fallbacks above."""
    name = (said or {}).get("implementation")
    kind = _BY_NAME.get((section, name))
    if kind:
        try:
            return kind.of(said or {})
        except TypeError as e:
            raise ConfigError(f"{section}: {e}") from e
    if section in _OTHERWISE:
        return _OTHERWISE[section]
    if section == "destination":
        raise ConfigError(f"unknown destination {name!r}")
    return Unknown(str(name))


@dataclass(frozen=True)
class Config:
    loading: Part
    embedding: Part
    destination: Part = field(default_factory=DestinationTable)
    chunking: Part = field(default_factory=ChunkingRecursive)
    formatting: Part = field(default_factory=FormattingTemplate)
    processing: Part = field(default_factory=Processing)
    version: str = "0.1.0"

    def to_json(self) -> str:
        return json.dumps({f.name: (v.to_dict() if isinstance(v := getattr(self, f.name), Part) else v) for f in fields(self)}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Config:
        said = json.loads(text)
        sections = ("loading", "embedding", "destination", "chunking", "formatting", "processing")
        return cls(**{s: part_of(s, said.get(s)) for s in sections}, version=str(said.get("version", "0.1.0")))


# constructors, by the names users know -----------------------------------------------------------------------

loading_column = LoadingColumn
chunking_none = ChunkingNone
chunking_character_text_splitter = ChunkingCharacter
chunking_recursive_character_text_splitter = ChunkingRecursive
chunking_sentence_chunker = ChunkingSentence
chunking_semchunk = ChunkingSemchunk
chunking_semantic_chunker = ChunkingSemantic
formatting_python_template = FormattingTemplate
formatting_chunk_value = FormattingChunk
destination_table = DestinationTable
destination_column = DestinationColumn
processing_default = Processing
embedding_ollama = EmbeddingOllama


def embedding_openai(model: str, dimensions: int, chat_user: str | None = None, api_key_name: str = "OPENAI_API_KEY", base_url: str | None = None) -> EmbeddingOpenAI:
    return EmbeddingOpenAI(model, dimensions, chat_user, api_key_name, base_url)
