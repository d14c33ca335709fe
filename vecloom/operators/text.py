"""Chunking algorithms on plain strings, the meaning that the Spark operators are held against.

Lengths are counted by ``length``, by default Unicode code points. Trimming removes Unicode White_Space
only (``str.strip`` without an argument would remove U+001C to U+001F as well).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

Length = Callable[[str], int]
Embed = Callable[[list[str]], Sequence[Sequence[float]]]
WHITE = "\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
DELIMITERS = (". ", "! ", "? ", "\n")
#: Where a configuration names no separators; the SQL-level default is in ``config``.
FALLBACK_SEPARATORS = ("\n\n", "\n", " ", "")


def trim(s: str) -> str:
    return s.strip(WHITE)


def split_regex(text: str, pattern: str, keep: str | None = None) -> list[str]:
    """Non-empty parts between matches; keep "start" or "end": a match stays at the start of the part after it, or at the end of the one before."""
    if not pattern:
        return list(text)
    marks = [(m.start(), m.end()) for m in re.finditer(pattern, text) if m.end() > m.start()]
    if keep == "start":
        cuts = [s for s, _ in marks]
    elif keep == "end":
        cuts = [e for _, e in marks]
    else:
        edges = [0, *[x for m in marks for x in m], len(text)]
        return [p for a, b in zip(edges[::2], edges[1::2]) if (p := text[a:b])]
    edges = [0, *cuts, len(text)]
    return [p for a, b in zip(edges, edges[1:]) if (p := text[a:b])]


def _joined(parts: Sequence[str], sep: str, strip: bool) -> list[str]:
    text = sep.join(parts)
    text = trim(text) if strip else text
    return [text] if text else []


def merge_splits(parts: Sequence[str], sep: str, size: int, overlap: int, strip: bool = True, length: Length = len) -> list[str]:
    """Windows of parts of ``size`` at most, each beginning with up to ``overlap`` of the one before."""
    gap, out, total = length(sep), [], 0
    held: list[str] = []
    for part in parts:
        n = length(part)
        if held and total + n + gap > size:
            out += _joined(held, sep, strip)
            while total > overlap or (total > 0 and total + n + (gap if held else 0) > size):
                total = max(0, total - length(held[0]) - (gap if len(held) > 1 else 0))
                del held[0]
        total += n + (gap if held else 0)
        held.append(part)
    return out + _joined(held, sep, strip)


def character_chunks(text: str, size: int, overlap: int, separator: str = "\n\n", regex: bool = False, strip: bool = True, length: Length = len) -> list[str]:
    """Parts between separators, merged with the separator as written, even if it is a pattern."""
    return merge_splits(split_regex(text, separator if regex else re.escape(separator)), separator, size, overlap, strip, length)


def recursive_chunks(
    text: str, size: int, overlap: int, separators: Sequence[str] = FALLBACK_SEPARATORS, regex: bool = False, keep: bool = True, strip: bool = True, length: Length = len
) -> list[str]:
    """Splits at the first separator that occurs; parts not shorter than ``size`` are split at those after it."""
    chosen, rest = (separators[-1] if separators else ""), ()
    for i, s in enumerate(separators):
        if not s:
            chosen = s
            break
        if _occurs(s, regex, text):
            chosen, rest = s, separators[i + 1 :]
            break
    parts = split_regex(text, chosen if regex else re.escape(chosen), "start" if keep else None)
    out: list[str] = []
    good: list[str] = []

    def flush() -> None:
        out.extend(merge_splits(good, "" if keep else chosen, size, overlap, strip, length))
        good.clear()

    for part in parts:
        if length(part) < size:
            good.append(part)
            continue
        flush()
        if rest:
            out += recursive_chunks(part, size, overlap, rest, regex, keep, strip, length)
        else:
            out.append(part)
    flush()
    return out


def _occurs(separator: str, regex: bool, text: str) -> bool:
    if not regex:
        return separator in text
    try:
        return re.search(separator, text) is not None
    except re.error:
        return False


@lru_cache(64)
def _sentence_pattern(delimiters: tuple[str, ...]) -> re.Pattern:
    return re.compile("(?s).*?(?:" + "|".join(map(re.escape, delimiters)) + ")|.+\\Z")


def sentences(text: str, delimiters: Sequence[str] = DELIMITERS) -> list[str]:
    """Up to and including each earliest delimiter (of several at one place, the first listed), then the rest."""
    delimiters = tuple(d for d in delimiters if d)
    if not delimiters:
        return [text] if text else []
    return [m for m in _sentence_pattern(delimiters).findall(text) if m]


def merge_short(parts: Sequence[str], least: int, length: Length = len) -> list[str]:
    """Parts joined until they have ``least``; what is left over goes to the last."""
    out, held = [], ""
    for part in parts:
        held += part
        if length(held) >= least:
            out.append(held)
            held = ""
    if held:
        if out:
            out[-1] += held
        else:
            out.append(held)
    return out


def pack(parts: Sequence[str], size: int, overlap: int, least: int = 1, strip: bool = True, drop_empty: bool = False, length: Length = len) -> list[str]:
    """Sentences packed greedily. After an overflow a chunk begins with the last sentences that ``overlap`` has room for, whichever chunks they were in."""
    lengths, out = [length(p) for p in parts], []
    first, count, total = 0, 0, 0

    def emit(end: int) -> None:
        text = "".join(parts[first:end])
        text = trim(text) if strip else text
        if text or not drop_empty:
            out.append(text)

    for i, n in enumerate(lengths):
        if count and total + n > size and count >= least:
            emit(i)
            first, total = i, 0
            while overlap > 0 and first > 0 and total + lengths[first - 1] <= overlap:
                first -= 1
                total += lengths[first]
            count = i - first
        elif not count:
            first = i
        total += n
        count += 1
    if count:
        emit(len(parts))
    return out


def sentence_chunks(text: str, size: int, overlap: int, delimiters: Sequence[str] = DELIMITERS, min_chars: int = 12, min_sentences: int = 1, strip: bool = True, length: Length = len) -> list[str]:
    parts = merge_short(sentences(text, delimiters), min_chars)
    return pack(parts, size, overlap, min_sentences, strip, False, length)


# the punctuation hierarchy ------------------------------------------------------------------------------------

_SPACED = lambda signs: [s + " " for s in signs]
_LINED = lambda signs: [s + "\n" for s in signs]
_ENDS, _CLOSE, _OPEN, _SIGNS, _LINKS = ".?!*", ")]}", "([{", "@#$%=+|", "/\\&-"
_DOTS = ("...", "…")
_ABOUT = lambda tail: [f" {s}{tail}" for s in _LINKS]
#: level -> delimiters (plain, strict); None: the longest run of the character.
LEVELS: tuple[tuple[str | None, list[str], list[str]], ...] = (
    ("\n", [], []),
    ("\t", [], []),
    (None, [x for d in _DOTS for x in (d + " ", d)] + _SPACED(_ENDS) + list(_ENDS), [x for d in _DOTS for x in (d + "\n", d + " ", d)] + _LINED(_ENDS) + _SPACED(_ENDS) + list(_ENDS)),
    (None, _SPACED(",;") + list(",;"), _LINED(",;") + _SPACED(",;") + list(",;")),
    (None, _SPACED(_CLOSE + _OPEN) + list(_CLOSE + _OPEN), _LINED(_CLOSE) + _SPACED(_OPEN + _CLOSE) + list(_CLOSE + _OPEN)),
    (None, _SPACED("\"'") + list("\"'"), _LINED("\"'") + _SPACED("\"'") + list("\"'")),
    (None, [" -- ", "-- ", ": ", ":", "--"], [_DOTS[0] + t for t in ("\n", " ", "")] + [" -- ", "-- ", ": ", ":\n", ":", "--"]),
    (None, _SPACED(_SIGNS) + list(_SIGNS), _LINED(_SIGNS) + _SPACED(_SIGNS) + list(_SIGNS)),
    (" ", [], []),
    (None, _ABOUT(" ") + list(_LINKS), _ABOUT("\n") + _ABOUT(" ") + list(_LINKS)),
)


def longest_run(text: str, char: str) -> str | None:
    return max(re.findall(re.escape(char) + "+", text), key=len, default=None)


def best_delimiter(text: str, delimiters: Sequence[str]) -> str | None:
    """Most UTF-8 bytes, then earliest in the text, then earliest in the list."""
    found = [(-len(d.encode()), at, k, d) for k, d in enumerate(delimiters) if (at := text.find(d)) >= 0]
    return min(found)[3] if found else None


def reattach(parts: Sequence[str], delimiter: str) -> list[str]:
    last = len(parts) - 1
    return [p + delimiter * (k < last) for k, p in enumerate(parts) if (p or k == 0) and (p or k < last)]


def fitting_merge(parts: Sequence[str], sep: str, size: int, overlap: int, strip: bool = True, length: Length = len) -> list[str]:
    """As many parts as fit, joined, one at least; the next begins with those that ``overlap`` has room for."""
    n, i, out, gap = len(parts), 0, [], length(sep)
    plain = length is len
    if plain:
        before = np.zeros(n + 1, np.int64)
        np.cumsum([len(p) + gap for p in parts], out=before[1:])
    while i < n:
        if plain:  # len(join(i..e)) = before[e] - before[i] - gap
            end = max(i + 1, int(np.searchsorted(before, before[i] + size + gap, "right")) - 1)
        else:
            lo, hi = i + 1, i + 2
            while hi <= n and length(sep.join(parts[i:hi])) <= size:
                lo, hi = hi, i + 2 * (hi - i)
            hi = min(hi, n + 1)
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if length(sep.join(parts[i:mid])) <= size else (lo, mid)
            end = lo
        out += _joined(parts[i:end], sep, strip)
        if end >= n:
            break
        start, total = end, 0
        while overlap and start > i:
            more = length(parts[start - 1]) + (gap if start < end else 0)
            if total + more > overlap:
                break
            total += more
            start -= 1
        i = end if not overlap else min(max(start, i + 1), end)
    return out


def hierarchy_chunks(text: str, size: int, overlap: int, strict: bool = False, strip: bool = True, length: Length = len) -> list[str]:
    """Splits at the weightiest punctuation there is, level by level, down to characters."""
    text = trim(text) if strip else text
    return _hierarchy(text, 0, size, overlap, strict, strip, length) if text else []


def _hierarchy(text: str, level: int, size: int, overlap: int, strict: bool, strip: bool, length: Length) -> list[str]:
    if length(text) <= size:
        return [text] if text else []
    for at in range(level, len(LEVELS)):
        run, plain, lined = LEVELS[at]
        delimiter = longest_run(text, run) if run else best_delimiter(text, lined if strict else plain)
        if delimiter is None:
            continue
        parts = text.split(delimiter)
        parts = [p for p in parts if p] if run else reattach(parts, delimiter)
        if len(parts) < 2:
            continue
        out: list[str] = []
        for chunk in fitting_merge(parts, delimiter if run else "", size, overlap, strip, length):
            out += _hierarchy(chunk, at + 1, size, overlap, strict, strip, length) if length(chunk) > size else [chunk]
        return out
    return fitting_merge(list(text), "", size, overlap, strip, length)


# embedding boundaries -----------------------------------------------------------------------------------------


def cosine(a: Sequence[float], b: Sequence[float]) -> np.float32:
    """In 32 bits; 0 for empty, unequal or zero vectors."""
    if len(a) != len(b) or not len(a):
        return np.float32(0)
    x, y = np.asarray(a, np.float32), np.asarray(b, np.float32)
    norm = np.sqrt((x * x).sum(dtype=np.float32)) * np.sqrt((y * y).sum(dtype=np.float32))
    return np.float32((x * y).sum(dtype=np.float32) / norm) if norm else np.float32(0)


def smooth(v: Sequence[float]) -> np.ndarray:
    """Savitzky-Golay, five points, second degree; two values at each end stay."""
    x = np.asarray(v, np.float32)
    if len(x) < 5:
        return x.copy()
    out = x.copy()
    k = np.array([-3, 12, 17, 12, -3], np.float32)
    out[2:-2] = sum((k[j] * x[j : len(x) - 4 + j] for j in range(5)), np.zeros(len(x) - 4, np.float32)) / np.float32(35)
    return out


def local_minima(v: Sequence[float]) -> list[int]:
    return [i for i in range(1, len(v) - 1) if v[i] < v[i - 1] and v[i] <= v[i + 1]]


def sentence_windows(parts: Sequence[str], width: int) -> list[str]:
    return ["".join(parts[i : i + width]) for i in range(len(parts) - width + 1)]


def boundaries(embedded: Sequence[Sequence[float]], width: int, n: int) -> list[int]:
    """Sentence numbers where the similarity of neighbouring windows dips."""
    similar = [cosine(a, b) for a, b in zip(embedded, embedded[1:])]
    return sorted({b for i in local_minima(smooth(similar)) if 0 < (b := i + width) < n})


def cut_at(parts: Sequence[str], bounds: Sequence[int], strip: bool = True) -> list[str]:
    out, start = [], 0
    for b in [*bounds, len(parts)]:
        if start < b <= len(parts):
            out += _joined(parts[start:b], "", strip)
            start = b
    return out


def reconnect(chunks: Sequence[str], embedded: Sequence[Sequence[float]], skip: int, threshold: float, max_aside: int) -> list[str]:
    """Joins a chunk with the farthest alike chunk up to ``skip`` asides away, and all between."""
    if len(chunks) < 3 or not skip:
        return list(chunks)
    out, i = [], 0
    while i < len(chunks):
        end = i
        for gap in range(1, min(skip, len(chunks) - i - 2) + 1):
            j = i + gap + 1
            if sum(map(len, chunks[i + 1 : j])) <= max_aside and cosine(embedded[i], embedded[j]) >= np.float32(threshold):
                end = j
        out.append("".join(chunks[i : end + 1]))
        i = end + 1
    return out


def semantic_chunks_of(
    texts: Sequence[str | None], embed: Embed | None, size: int, overlap: int, width: int = 3, skip: int = 0, threshold: float = 0.75, max_aside: int = 512, delimiters: Sequence[str] = DELIMITERS, min_chars: int = 12
) -> list[list[str]]:
    """Of many texts at once, so that their windows share calls of ``embed``. Without ``embed`` no boundary is found."""
    plans: list[list[str] | None] = []
    windows: list[str] = []
    for text in texts:
        parts = merge_short(sentences(text, delimiters), min_chars) if text and trim(text) else None
        plans.append(parts)
        if parts and embed and width and len(parts) > width:
            windows += sentence_windows(parts, width)
    vectors = list(embed(windows)) if windows else []
    done, chunked = 0, []
    for parts in plans:
        if not parts:
            chunked.append([])
        elif not width or len(parts) <= width:
            chunked.append(pack(parts, size, overlap, drop_empty=True))
        else:
            k = len(parts) - width + 1 if embed else 0
            bounds = boundaries(vectors[done : done + k], width, len(parts))
            done += k
            chunked.append(cut_at(parts, bounds) or [trim("".join(parts))])
    joinable = [i for i, c in enumerate(chunked) if skip and embed and len(c) >= 3]
    vectors = list(embed([c for i in joinable for c in chunked[i]])) if joinable else []
    done = 0
    for i in joinable:
        k = len(chunked[i])
        chunked[i] = reconnect(chunked[i], vectors[done : done + k], skip, threshold, max_aside)
        done += k
    return [[x for c in chunks for x in ([c] if len(c) <= size else pack(sentences(c, delimiters), size, overlap, drop_empty=True))] for chunks in chunked]
