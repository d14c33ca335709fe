"""Chunking on plain strings: known cases and what must always hold."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecloom.operators import text as T

LETTERS = st.text(alphabet="ab. !?\n,;()\"'-:éß日 　\t…", max_size=120)


def solid(s):
    return "".join(s.split())


@pytest.mark.parametrize(
    ("text", "pattern", "keep", "want"),
    [
        ("hello world foo", " ", None, ["hello", "world", "foo"]), ("hello world foo", " ", "start", ["hello", " world", " foo"]), ("hello world foo", " ", "end", ["hello ", "world ", "foo"]),
        ("abc", "", None, ["a", "b", "c"]), ("a  b", " ", None, ["a", "b"]), ("foo123bar456baz", r"\d+", None, ["foo", "bar", "baz"]), ("", " ", None, []),
    ],
)
def test_split_regex(text, pattern, keep, want):
    assert T.split_regex(text, pattern, keep) == want


@pytest.mark.parametrize(
    ("parts", "sep", "size", "overlap", "want"),
    [
        (["foo", "bar", "baz", "123"], " ", 7, 3, ["foo bar", "bar baz", "baz 123"]), (["aa", "bb", "cc", "dd"], " ", 5, 0, ["aa bb", "cc dd"]), ([" a ", " b "], " ", 100, 0, ["a   b"]), ([], " ", 5, 0, []),
        ([" "], "", 5, 0, []),
    ],
)
def test_merge_splits(parts, sep, size, overlap, want):
    assert T.merge_splits(parts, sep, size, overlap) == want


def test_merge_splits_by_words():
    parts = ["one two", "three", "four five", "six"]
    assert len(T.merge_splits(parts, " ", 3, 0, length=lambda s: len(s.split()))) == 2


def test_character():
    assert T.character_chunks("foo bar baz a a", 3, 1, " ") == ["foo", "bar", "baz", "a a"]
    assert T.character_chunks("foo  bar\tbaz", 7, 0, r"\s+", True) == ["foo", "bar", "baz"]
    assert T.character_chunks("hello.world.test", 10, 0, ".") == ["hello", "world.test"]
    assert T.character_chunks("Hello World\n\nFoo Bar\n\nBaz", 20, 0) == ["Hello World\n\nFoo Bar", "Baz"]
    assert T.character_chunks("", 5, 0) == []


def test_recursive():
    got = T.recursive_chunks("abc123def456ghi", 10, 0, [r"\d+"], True, False)
    assert len(got) == 2 and got[0].startswith("abc") and got[1] == "ghi"
    assert T.recursive_chunks("one two three", 100, 0) == ["one two three"]
    assert T.recursive_chunks("abc", 1, 0, [""]) == ["a", "b", "c"]


def test_sentences():
    assert T.sentences("Hello world. How are you? Fine! Thanks.") == ["Hello world. ", "How are you? ", "Fine! ", "Thanks."]
    assert T.merge_short(["Hi. ", "How are you? ", "Good. "], 10) == ["Hi. How are you? Good. "]
    assert T.sentence_chunks("Hello world. ", 100, 0) == ["Hello world."]
    assert T.sentence_chunks("A. B. C. D.", 7, 0, min_chars=1, min_sentences=2) == ["A. B.", "C. D."]
    text = "This is the first sentence. Here comes the second one. And the third one is here."
    a, b = T.sentence_chunks(text, 60, 35)[:2]
    assert "Here comes the second one." in a and "Here comes the second one." in b


def test_hierarchy():
    assert T.hierarchy_chunks("AAAAAAA\n\n\nBBBBBBB\nCCCCCCC", 10, 0)[0] == "AAAAAAA"
    assert T.best_delimiter("Alpha... Beta: Gamma", T.LEVELS[2][1]) == "... "
    assert T.best_delimiter("a… b", ["..", "…"]) == "…" and T.best_delimiter("ab", ["x"]) is None
    assert T.longest_run("a\n\nb\n\n\nc", "\n") == "\n\n\n" and T.longest_run("a", "\n") is None
    assert T.hierarchy_chunks("  ", 10, 0) == []


def test_semantic():
    def embed(inputs):
        return [[float(sum(w in t.lower() for w in ("cat", "dog"))), float(sum(w in t.lower() for w in ("stock", "bond")))] for t in inputs]

    text = "The cat sat still. The dog ran off. A cat saw a dog. The stock rose high. The bond fell low. A stock beats a bond."
    got = T.semantic_chunks_of([text, None, " "], embed, 1000, 0, 2)
    assert got[1:] == [[], []] and solid("".join(got[0])) == solid(text)
    assert T.semantic_chunks_of([text], None, 1000, 0, 2) == [[text]]
    assert T.reconnect(["a", "x", "b"], [[1.0, 0], [0, 1.0], [1.0, 0]], 1, 0.9, 10) == ["axb"]
    assert T.reconnect(["a", "x" * 11, "b"], [[1.0, 0], [0, 1.0], [1.0, 0]], 1, 0.9, 10) == ["a", "x" * 11, "b"]
    assert T.smooth([1, 2, 3]).tolist() == [1, 2, 3] and T.local_minima([3, 1, 1, 2]) == [1]
    assert T.cosine([], []) == 0 and T.cosine([1, 0], [1]) == 0 and T.cosine([0, 0], [1, 0]) == 0


@settings(max_examples=150, deadline=None)
@given(LETTERS, st.integers(1, 30), st.integers(0, 15), st.booleans())
def test_nothing_is_lost_without_overlap(text, size, overlap, strict):
    chunks = T.recursive_chunks(text, size, 0)
    assert solid("".join(chunks)) == solid(text) and all(0 < len(c) <= size for c in chunks)
    chunks = T.hierarchy_chunks(text, size, 0, strict)
    assert all(0 < len(c) <= size for c in chunks)
    # of delimiters side by side some may go: the empty part between them does
    letters = "".join(c for c in text if c.isalnum())
    assert "".join(c for c in "".join(chunks) if c.isalnum()) == letters
    assert solid("".join(T.sentence_chunks(text, size, 0))) == solid(text)
    assert solid("".join(T.character_chunks(text, size, 0, "\n"))) == solid(text)
    assert all(len(c) <= size for c in T.hierarchy_chunks(text, size, overlap, strict))
    assert "".join(T.sentences(text)) == text


@settings(max_examples=60, deadline=None)
@given(LETTERS)
def test_trim_is_unicode(text):
    assert T.trim(text) == text.strip(T.WHITE) and T.trim("\x1c a　") == "\x1c a"
