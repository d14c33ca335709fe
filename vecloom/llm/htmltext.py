"""Main text of HTML pages by text-to-tag ratio.

The standard library's streaming parser reads a page in chunks, and its events make lines: a line ends at a
block-level tag or a line end of the source. Each line's ratio is its characters of text per
tag. Ratios are smoothed by a Gaussian over neighbouring lines, so that short paragraphs
amid long ones stay and stray long lines amid menus go, and lines whose smoothed ratio reaches the threshold, a share of the standard
deviation of the page's smoothed ratios, form the content.

Defined results
* null page: null content and counts of 0; empty page, or one without text: empty content;
* if all smoothed ratios are equal (one line, say), all lines with text are content;
* script, style, template, noscript, svg and head have no text; character references are resolved, blanks and line ends are one blank;
* what is begun but never ended (a tag, a comment, a section) is text, and a silent element that is never closed, other than script and style, hides nothing;
* broken markup never fails: where the parser refuses a declaration, all ``<!`` of the page are text;
* a null id is reported as null; repeated rows are each extracted; an empty table gives an empty result; other columns are ignored;
* pages are read whole at any length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import texts

RADIUS, SIGMA, SHARE = 2, 1.0, 0.5
CHUNK = 1 << 16
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset(("script", "style", "template", "noscript", "svg", "head"))
#: Of these, the ones that hide all that follows even where they are never closed.
RAW = frozenset(("script", "style"))
_LINE_ENDS = re.compile("[\r\n]").split
_KERNEL = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))


class Events(HTMLParser):
    """What the parser reports: (kind, tag or text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.events.append(("start", tag))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.events.append(("empty", tag))

    def handle_endtag(self, tag: str) -> None:
        self.events.append(("end", tag))

    def handle_data(self, data: str) -> None:
        self.events.append(("data", data))


def _finished(page: str) -> str:
    """``page`` with what can't end any more as text: tags after the last ``>``, comments and sections after their last ends. The parser would look for the end from each."""
    for begin, end in (("<!--", "-->"), ("<![", "]>"), ("<", ">")):
        at = page.rfind(end) + 1
        if page.find(begin, at) >= 0:
            page = page[:at] + page[at:].replace(begin, "&lt;" + begin[1:])
    return page


def _events(page: str) -> list[tuple[str, str]]:
    parser = Events()
    step = max(CHUNK, len(page) // 16 + 1)  # what is unfinished at the end of a chunk is read again
    for k in range(0, len(page), step):
        parser.feed(page[k : k + step])
    parser.close()
    return parser.events


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, tags) of each line with text."""
    page = _finished(page)
    try:
        events = _events(page)
    except AssertionError:
        events = _events(page.replace("<!", "&lt;!"))
    # a silent element that is never closed is none, but for scripts and styles
    ends, closed = dict.fromkeys(SILENT, 0), [False] * len(events)
    for k in range(len(events) - 1, -1, -1):
        kind, tag = events[k]
        if kind != "data" and tag in SILENT:
            if kind == "end":
                ends[tag] += 1
            elif kind == "start":
                closed[k] = tag in RAW or ends[tag] > 0
                ends[tag] = max(0, ends[tag] - 1)
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    silent: list[str] = []
    tags = 0

    def end_line() -> None:
        nonlocal tags
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            lines.append((text, tags))
            tags = 0

    for k, (kind, what) in enumerate(events):
        if kind == "data":
            if not silent:
                first, *more = _LINE_ENDS(what)
                parts.append(first)
                for x in more:
                    end_line()
                    parts.append(x)
            continue
        if kind == "start":
            if closed[k]:
                silent.append(what)
            elif what == "body":
                silent.clear()  # an unclosed head
        elif kind == "end" and what in silent:
            del silent[silent.index(what) :]
        if what in BLOCK:
            end_line()
        tags += 1
    end_line()
    return lines


def content_lines(lines: list[tuple[str, int]]) -> np.ndarray:
    """Which lines are content."""
    if not lines:
        return np.zeros(0, bool)
    ratio = np.array([len(text) / max(tags, 1) for text, tags in lines])
    smooth = np.convolve(np.pad(ratio, RADIUS), _KERNEL, "valid") / np.convolve(np.pad(np.ones(len(ratio)), RADIUS), _KERNEL, "valid")
    threshold = SHARE * smooth.std()
    if math.isclose(smooth.min(), smooth.max(), rel_tol=1e-9):
        return np.ones(len(ratio), bool)
    return smooth >= threshold


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, total, kept = [], [], []
        for page in batch.column(1).to_pylist():
            lines = lines_of(page) if page else []
            keep = content_lines(lines)
            text.append(None if page is None else "\n".join(line for (line, _), k in zip(lines, keep) if k))
            total.append(len(lines))
            kept.append(int(keep.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(total, pa.int64()), pa.array(kept, pa.int64())], ["page_id", "content", "n_lines", "n_kept"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, content, n_lines, n_kept. No shuffle."""
    return texts(pages, id_col, html_col).mapInArrow(_batches, "page_id long, content string, n_lines long, n_kept long")
