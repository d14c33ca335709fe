"""SentencePiece encoding and decoding by a weighted transducer.

The model file is compiled to a transducer T = normaliser . pieces . byte fallback. Its states are the
last piece read; an arc reads a piece's characters and writes its id, or, for a character that no piece has, the ids
of its UTF-8 bytes. A text is composed with T position by position, and of the paths in the
lattice (position, last piece) the one of least weight in the tropical semiring (min, +) is written out.

* Unigram models: an arc weighs minus the piece's score, an unknown character 10 more than the rarest piece; the last piece doesn't matter.
* BPE models: scores are ranks of merges, not log-probabilities, and a sum of them means nothing. The arc from piece a to
  piece b weighs 0 where merging the characters of a + b yields just (a, b), and infinity elsewhere. A sequence is what BPE
  makes of a text if and only if all its adjacent pairs are such pairs, and every prefix of a text has one such sequence, so
  exactly one path has a finite weight, the right one.

No piece crosses the start of a run of spaces or a line end (checked when a model is compiled; if one does, texts aren't cut),
so the shortest path of a text is that of its segments, and those are kept in a bounded cache.

Defined results
* null text: null ids and counts; empty text: no ids; a null id is reported as null; repeated rows are each encoded;
* exact: decoding gives the text again; false only where it holds the space mark U+2581 itself, or the model changes texts;
* ids that are control pieces, or no pieces, decode to nothing;
* an empty table gives an empty result; other columns are ignored; texts are encoded whole at any length.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .frames import texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHED_SEGMENTS, CACHED_PAIRS = 200_000, 1_000_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        r = s = 0
        while True:
            r |= (b[i] & 127) << s
            i, s = i + 1, s + 7
            if b[i - 1] < 128:
                return r, i

    i = 0
    while i < len(b):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class Transducer:
    """A compiled model; ``ids`` encodes a text and ``text`` decodes ids."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            blob = f.read()
        pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normal: dict = {}
        for k, v in _fields(blob):
            if k == 1:
                x = dict(_fields(v))
                pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                normal = dict(_fields(v))
        if normal.get(2):
            raise ValueError("models with a character map aren't supported")
        self.bpe = trainer.get(3, 1) == 2
        self.prefix, self.squeeze, self.escape = normal.get(3, 1), normal.get(4, 1), normal.get(5, 1)
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER)}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.longest = max(map(len, self.id), default=1)
        self.unknown_cost = 10.0 - min(self.score.values(), default=0.0)
        crossing = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.id)
        self.segments = re.compile(".+" if crossing else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n", re.S).findall
        self.back = [p.replace(SPACE, " ").encode() if kind in (NORMAL, USER) else bytes([int(p[3:5], 16)]) if kind == BYTE else "⁇".encode() if kind == UNKNOWN else b"" for p, _, kind in pieces]
        lengths: dict[str, set[int]] = {}
        for p in self.id:
            lengths.setdefault(p[:3], {1}).add(len(p))
        for p in self.id:
            lengths.setdefault(p[:2], {1}).add(len(p[:2]))
        #: Lengths, descending, of the pieces that begin with three characters (or are shorter).
        self.lengths = {k: tuple(sorted(v | (lengths.get(k[:2], set()) if len(k) > 2 else set()), reverse=True)) for k, v in lengths.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        outer = self

        class Cache(dict):
            """Two generations: a full one becomes the old one, and what is asked for again moves on."""

            old: dict[str, bytes] = {}

            def __missing__(self, segment: str) -> bytes:
                if len(self) >= CACHED_SEGMENTS:
                    self.old = dict(self)
                    self.clear()
                found = self.old.get(segment)
                if found is None:
                    ids = outer.path(segment)
                    found = struct.pack(f"<{len(ids)}i", *ids)
                self[segment] = found
                return found

        self.cache = Cache()

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return text
        if self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def merged(self, text: str) -> list[str]:
        """BPE's own definition: of adjacent parts that make a piece, merge the best, leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1], -math.inf)
                if s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: str, b: str) -> bool:
        """Whether the arc from a to b has a finite weight; a is empty at the start."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= CACHED_PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def path(self, s: str) -> list[int]:
        """Ids on the shortest path of a segment."""
        n, pieces, longest = len(s), self.id, self.longest
        if self.bpe:
            return self.written(self.only_path(s))
        cost, last = [0.0] + [math.inf] * n, [""] * (n + 1)
        for e in range(1, n + 1):
            for b in range(max(0, e - longest), e):
                p = s[b:e]
                if p in pieces:
                    c = cost[b] - self.score[p]
                elif b + 1 == e:
                    c = cost[b] + self.unknown_cost
                else:
                    continue
                if c < cost[e]:
                    cost[e], last[e] = c, p
        out, e = [], n
        while e:
            out.append(last[e])
            e -= len(last[e])
        return self.written(out[::-1])

    def only_path(self, s: str) -> list[str]:
        """Pieces on the one path of finite weight, depth first, long arcs first.

        A place is reached in one state only, so a place from which there is no way on is dead for good.
        """
        n, pieces, lengths, fits, fit = len(s), self.id, self.lengths, self.fits, self.fit
        out: list[str] = []
        dead: set[int] = set()
        i, most, last = 0, n, ""
        while i < n:
            for size in lengths.get(s[i : i + 3]) or lengths.get(s[i : i + 2]) or (1,):
                if size <= most and i + size <= n and (not dead or i + size not in dead):
                    p = s[i : i + size]
                    if size == 1 or p in pieces:
                        pair = (last, p)
                        if fits[pair] if pair in fits else fit(last, p):
                            out.append(p)
                            i, most, last = i + size, n, p
                            break
            else:
                dead.add(i)
                p = out.pop()
                i, most, last = i - len(p), len(p) - 1, out[-1] if out else ""
        return out

    def written(self, path: list[str]) -> list[int]:
        """What the arcs of a path write."""
        pieces, out = self.id, []
        for p in path:
            if p in pieces:
                out.append(pieces[p])
            elif self.byte:
                out += [self.byte[x] for x in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def packed(self, text: str) -> bytes:
        """Ids as 32-bit numbers."""
        return b"".join(map(self.cache.__getitem__, self.segments(self.normalised(text))))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def text(self, ids: list[int]) -> str:
        back, n = self.back, len(self.back)
        out = b"".join([back[i] if 0 <= i < n else b"" for i in ids]).decode("utf-8", "replace")
        return out[1:] if self.prefix and out[:1] == " " else out


_compiled: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(path)
        back = t.back.__getitem__
        for whole in batches:
            for k in range(0, len(whole), 1000):  # lists of ids take several times a text's room
                batch = whole.slice(k, 1000)
                loads, exact = [], []
                for text in batch.column(1).to_pylist():
                    if text is None:
                        loads.append(b"")
                        exact.append(None)
                        continue
                    load = t.packed(text)
                    loads.append(load)
                    again = b"".join(map(back, np.frombuffer(load, "<i4").tolist())).decode("utf-8", "replace")
                    exact.append((again[1:] if t.prefix and again[:1] == " " else again) == text)
                n = np.array([len(x) // 4 for x in loads], np.int32)
                off = np.zeros(len(n) + 1, np.int32)
                np.cumsum(n, out=off[1:])
                null = pa.array([x is None for x in exact], pa.bool_())
                ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(loads), "<i4")), mask=null)
                count = pa.array(n.astype(np.int64), mask=null.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, count, pa.array(exact, pa.bool_())], ["doc_id", "ids", "n_ids", "exact"])

    return encode


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_ids, exact. ``model`` must be readable at that path on every executor. No shuffle."""
    return texts(docs, id_col, text_col).mapInArrow(_encode(model), "doc_id long, ids array<int>, n_ids long, exact boolean")


def decode(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with ``text_col`` decoded from ``ids_col``; null stays null."""

    def decoded(ids: pa.Array) -> pa.Array:
        t = compiled(model)
        return pa.array([None if x is None else t.text(x) for x in ids.to_pylist()], pa.string())

    return encoded.withColumn(text_col, F.arrow_udf(decoded, StringType())(F.col(f"`{ids_col}`")))
