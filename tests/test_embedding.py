"""Batches, retries, error classes, providers against a local server, configuration."""

import json
import pickle
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from vecloom import cli
from vecloom import config as C
from vecloom.operators import embedding as E
from vecloom.operators import errors as X


@pytest.mark.parametrize(
    ("tokens", "inputs", "most", "want"),
    [
        ([5] + [1] * 8, 3, None, [(0, 3), (3, 6), (6, 9)]), ([5] + [1] * 8, 5, 6, [(0, 2), (2, 7), (7, 9)]), ([1, 8, 2, 5, 9, 5, 6, 11], 5, 20, [(0, 4), (4, 7), (7, 8)]), ([], 3, 3, []),
    ],
)
def test_batches(tokens, inputs, most, want):
    assert E.batch_ranges(tokens, inputs, most) == want


def test_a_chunk_over_the_limit():
    with pytest.raises(X.EmbeddingError):
        E.batch_ranges([5], 10, 2)
    embedder = E.letter_embedder("a")
    embedder.max_tokens = 2
    (a, b) = E.embedded(["a" * 50, "aa"], embedder)
    assert a[0] is None and a[2] == "permanent" and b[0] == [2.0]


@pytest.mark.parametrize(("status", "transient"), [(400, False), (401, False), (403, False), (418, False), (429, True), (500, True), (503, True), (302, True)])
def test_status(status, transient):
    assert X.transient_status(status) is transient


@pytest.mark.parametrize(
    ("message", "transient", "status", "code"),
    [
        ("HTTP 503 unavailable", True, 503, None), ("status 429", True, 429, "x"), ("Invalid API key", False, None, "invalid_api_key"), ("401 Main Street", True, None, None), ("http 12345", True, None, None),
        ('{"code":"Odd"}', True, None, "Odd"), ("rate limit reached", True, None, "rate_limit_exceeded"), ("billing", False, None, None), ("", True, None, None), ('"code":""', True, None, None),
    ],
)
def test_messages(message, transient, status, code):
    assert X.transient_message(message) is transient and X.status_in(message) == status
    assert X.code_in(message) == (None if code == "x" else code)


def test_retry_waits_and_gives_up():
    waits, calls = [], []

    def fail(transient):
        def call():
            calls.append(1)
            raise X.EmbeddingError("no", transient)

        return call

    with pytest.raises(X.EmbeddingError) as e:
        E.with_retry(fail(True), sleep=waits.append)
    assert waits == [1.0, 2.0] and len(calls) == 3 and e.value.attempts == 3
    calls.clear()
    with pytest.raises(X.EmbeddingError):
        E.with_retry(fail(False), sleep=waits.append)
    assert len(calls) == 1


@pytest.fixture
def server():
    seen, answers = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, dict(self.headers), body))
            status, said = answers.pop(0) if answers else (200, None)
            vectors = [[float(len(t)), 1.0] for t in body["input"]]
            said = said if said is not None else {"embeddings": vectors, "data": [{"embedding": v} for v in vectors]}
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode())

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen, answers
    http.shutdown()


def test_providers(server):
    url, seen, answers = server
    ollama = pickle.loads(pickle.dumps(E.OllamaEmbedder("m", url, context=1)))
    assert ollama.embed(["abcdefgh", "x"]) == [[4.0, 1.0], [1.0, 1.0]] and seen[-1][0] == "/api/embed" and seen[-1][2] == {"model": "m", "input": ["abcd", "x"]}
    openai = E.OpenAIEmbedder("some-model", "k", 2, f"{url}/v1")
    assert openai.embed(["abc"]) == [[3.0, 1.0]]
    path, headers, body = seen[-1]
    assert path == "/v1/embeddings" and headers["Authorization"] == "Bearer k" and body == {"model": "some-model", "input": ["abc"], "dimensions": 2} and "k'" not in repr(openai)
    answers += [(503, {}), (429, {"error": {"code": "insufficient_quota", "message": "pay"}})]
    waits = []
    (row,) = E.embedded(["abc"], openai, sleep=waits.append)
    assert row[0] is None and row[2:5] == ("permanent", 429, "insufficient_quota") and row[5] == 2 and waits == [1.0]
    (row,) = E.embedded(["abc"], openai, dimensions=3)
    assert "dimensions" in row[1]
    with pytest.raises(X.EmbeddingError) as e:
        E.OllamaEmbedder("m", "http://127.0.0.1:9").embed(["a"])
    assert e.value.transient


def test_requests_are_batched(server):
    url, seen, _ = server
    rows = E.embedded(["word " * 1000] * 400, E.OpenAIEmbedder("m", "k", base_url=url))
    assert len(rows) == 400 and all(r[0] for r in rows) and len(seen) >= 2


def test_urls_and_keys(monkeypatch):
    assert E.ollama_url("https://h") == "https://h:11434" and E.ollama_url("http://h:1/x") == "http://h:1"
    monkeypatch.setenv("OLLAMA_HOST", "http://o:2")
    assert E.ollama_url(None) == "http://o:2"
    with pytest.raises(C.ConfigError):
        E.ollama_url("nothing")
    monkeypatch.setenv("A_KEY", "v")
    assert E.api_key("A_KEY") == "v" and E.api_key("B_KEY", {"B_KEY": "s"}.get) == "s"
    with pytest.raises(C.ConfigError, match="neither"):
        E.api_key("C_KEY")
    with pytest.raises(C.ConfigError, match="secret store"):
        E.api_key("C_KEY", lambda _: 1 / 0)
    with pytest.raises(C.ConfigError, match="unknown embedding"):
        E.make_embedder(C.part_of("embedding", {"implementation": "nope"}))


def test_truncate_and_estimate():
    assert E.estimated_tokens("") == 0 and E.estimated_tokens("abcde") == 2 and E.estimated_tokens("日") == 1
    assert E.truncated("abcdefgh", 1) == "abcd" and E.truncated("ab", 1) == "ab" and E.truncated("日日", 1) == "日"

    class Words:
        def encode(self, t):
            return t.split()

        def decode(self, ids):
            return " ".join(ids)

    assert E.truncated("a b c", 2, Words()) == "a b"


def test_config_round_trip_and_fallbacks():
    cfg = C.Config(C.loading_column("c"), C.embedding_openai("m", 3, base_url="u"), chunking=C.chunking_sentence_chunker(10, 2), formatting=C.formatting_chunk_value(), processing=C.processing_default(5, 20))
    assert C.Config.from_json(cfg.to_json()) == cfg and cfg.processing.executors == 10 and C.Processing().rows == 50
    said = json.loads(C.Config(C.loading_column("c"), C.embedding_ollama("m", 3)).to_json())
    assert said["embedding"] == {"implementation": "ollama", "config_type": "embedding", "model": "m", "dimensions": 3} and said["version"] == "0.1.0"
    assert C.part_of("chunking", {"implementation": "odd"}) == C.ChunkingNone() and C.part_of("formatting", None) == C.FormattingChunk()
    assert C.part_of("chunking", {"implementation": "semchunk", "chunk_size": 3, "odd": 1}).chunk_size == 3
    with pytest.raises(C.ConfigError):
        C.part_of("destination", {"implementation": "odd"})
    with pytest.raises(C.ConfigError):
        C.part_of("chunking", {"implementation": "semchunk", "chunk_size": -1})


def test_command_line():
    args = cli.parser().parse_args(["worker", "--root", "r", "--once", "-i", "1", "2", "--poll-interval", "5m"])
    assert args.once and args.vectorizer_ids == [1, 2] and args.poll_interval.seconds == 300 and args.exit_on_error is None
    assert cli.redacted("postgres://u:secret@h/d") == "postgres://u:***@h/d"
