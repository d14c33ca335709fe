"""Unbounded n-gram scores of every document against all the others.

Each word is predicted from the longest context before it, back to the start of its document, that some *other* document
holds too; the start itself counts as a word of the context. With ``c`` the occurrences of that context in other documents (at their ends too), and
``d`` those that the word follows, ``p = (d + KAPPA / VOCABULARY) / (c + KAPPA)``: what the corpus says, smoothed towards a uniform
word. The empty context occurs before every word of the other documents. Context lengths are exact, whatever they are.

A context's occurrences are counted in suffix arrays: sorted arrays of the corpus' contexts (as 64-bit hashes of a length and that many
words), sharded by hash, so that all suffixes that agree in so many words are one range of one shard. A block of documents sends each of its
contexts once, with its number, and is answered with the width of the range, a run of the sorted array; what a document holds itself it subtracts.
The longest matching context is found by a search over lengths. All words ask for 1; those matched for 2, at 2 for 3 and 4, at 4 for 8, 16 and 32, at 32
for all powers of two up to the start; then the gaps are halved twice a round until the lengths are known to the word. A match is longer by one at most
than that of the word before, so where one is known, those after it ask for no more than they can have.
A context matched at both ends of a gap by as many occurrences asks no more there, as none of them can end in between; all others ask along, so every
count is complete. The continuation count needs no search of its own: a word that follows its context elsewhere has itself a match that is longer by one.

Equal texts are one text with a weight. Rounds move only hashes and counts; of the words a block keeps those that open contexts reach. No task holds a
document's copies, or all occurrences of a context: blocks count theirs before they send.

A word is a run of bytes above 0x20 as it stands. 64-bit hashes stand for contexts.

Defined results
* null, empty and blank texts: no words, log probability 0, perplexity and mean context null;
* rows with a null id are neither scored nor part of the corpus; rows that repeat an id are one document, their texts one after the other in order, scored in sum;
* an empty table gives an empty result; other columns are ignored; texts are scored whole at any length;
* equal contexts of one document (ties) are each scored; a lone document scores ``1 / VOCABULARY`` a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import discard, memory_kept, packed, released, stored, texts, unpacked, written
from .textbytes import blocks, mix, word_hashes, _powers

KAPPA, VOCABULARY = 1.0, 1_000_000
#: Words of a block, about, and questions for a shard: blocks put equal ones as one, so it has a quarter of them or so.
BLOCK_WORDS, SHARD_CONTEXTS = 300_000, 3_000_000
#: Lengths that the first rounds ask for; the next asks for all further powers of two.
LEVELS = ((1,), (2,), (3, 4), (8, 16, 32))
_START = np.uint64(0x51A27B1E5E2C9D37)
_STEP = 1 << 15
_ANSWER = "block long, shard long, load binary"


def _order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices that sort ``key``, equal ones by index; the sorted keys; which of them differ from the one before."""
    bits = np.uint64(max(len(key) - 1, 1).bit_length())
    least, most = (key.min(), key.max()) if len(key) else (np.uint64(0), np.uint64(0))
    free = np.uint64(64 - max(int(most - least), 1).bit_length())
    s = (key - least) << free if free else key.copy()  # keys that lie close together differ at the top, too
    s >>= bits
    s <<= bits
    s |= np.arange(len(key), dtype=np.uint64)
    s.sort()
    o = (s & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    found = key[o]
    new = np.ones(len(key), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    s >>= bits
    mixed = np.flatnonzero((s[1:] == s[:-1]) & new[1:])
    if len(mixed):  # keys that differ in their low bits only: sort their runs as they are
        for high in np.unique(s[mixed]):
            run = slice(np.searchsorted(s, high), np.searchsorted(s, high, "right"))
            o[run] = o[run][np.argsort(found[run], kind="stable")]
        found = key[o]
        np.not_equal(found[1:], found[:-1], out=new[1:])
    return o, found, new


def _sizes(first: np.ndarray, n: int) -> np.ndarray:
    """How long the runs are that begin at ``first``, of ``n`` in all."""
    return np.diff(first, append=n)


class Block:
    """Documents by their words, and how far the search has come. Of a document it has the stretches of words that are needed still."""

    #: key, words, weight, sum, context: of each document; at, of, start: where stretches begin among the words, their documents, and places there.
    #: size, count: of each word's longest match so far; live: words of the next ladder; gap: words with an open gap; far: how long their matches can be.
    FIELDS = ("key", "words", "weight", "sum", "context", "at", "of", "start", "dictionary", "code", "size", "count", "done", "live", "top", "far_live", "gap", "low", "high", "n_low", "n_high", "far", "seen")
    _PLAIN = FIELDS.index("code"), FIELDS.index("done")

    def __init__(self, load: memoryview, counts: bool = True) -> None:
        """counts: whether those of single words are wanted, or only whether other documents hold them."""
        self.__dict__.update(zip(self.FIELDS, unpacked(load, self._PLAIN)))
        self.key, self.dictionary = self.key.reshape(-1, 2), self.dictionary.astype(np.uint64)
        low, middle, top = self.code.reshape(3, -1)
        self.code = top.astype(np.int64)
        for plane in (middle, low):
            self.code <<= 8
            self.code |= plane
        self.live, self.gap = np.cumsum(self.live), np.cumsum(self.gap)
        self.done = self.done.copy()
        self._placed()
        if len(self.seen):
            self._first(counts)

    def _first(self, counts: bool) -> None:
        """What is known once the corpus' number of each word (``seen``) is: kept by word, not by place, as it takes less room."""
        total = self.seen[self.code]
        here = np.bincount(self.code, self.weight[self.doc], len(self.dictionary)).astype(np.int64)
        # a word that other blocks hold too is in other documents, however often it is in this one
        some = np.arange(len(total)) if counts else np.flatnonzero((self.seen == here)[self.code])
        o, _, new = _order((self.doc[some] * len(self.dictionary) + self.code[some]).astype(np.uint64))
        size = _sizes(np.flatnonzero(new), len(o))
        own = np.zeros(len(total), np.int64)
        own[some[o]] = np.repeat(size, size)
        self.size = (total > own).astype(np.int64)
        self.count = (total - own) * self.size
        self.live = np.flatnonzero(self.size)
        self.top, self.seen = total[self.live], self.seen[:0]
        self.far_live = self.most(self._spent())[self.live]

    def _placed(self) -> None:
        n, long = len(self.code), np.diff(self.at)
        self.doc = np.repeat(self.of, long)
        self.place = np.arange(n) + np.repeat(self.start - self.at[:-1], long)

    @classmethod
    def load_of(cls, key: np.ndarray, lengths: np.ndarray, weight: np.ndarray, h: np.ndarray) -> bytes:
        o, found, new = _order(h)
        first = np.flatnonzero(new)
        often = _sizes(first, len(h))
        frequent = np.argsort(-often, kind="stable")
        rank = np.empty(len(first), np.int64)
        rank[frequent] = np.arange(len(first))
        code = np.empty(len(h), np.int64)
        code[o] = np.repeat(rank, often)
        n, docs, none = len(h), len(lengths), np.zeros(0, np.int64)
        zeros = np.zeros(n, np.int64)
        live = np.r_[0, np.ones(n - 1, np.int64)]
        of_docs = key.ravel(), lengths - 1, weight, np.zeros(docs), np.zeros(docs)
        return packed(*of_docs, np.r_[0, np.cumsum(lengths)], np.arange(docs), np.zeros(docs, np.int64), found[first[frequent]], cls._bytes(code), zeros, zeros, zeros, live, *[none] * 9)

    @staticmethod
    def _bytes(code: np.ndarray) -> np.ndarray:
        """The low three bytes of each code, one after the other: only a text of more than 16 million different words needs more."""
        if len(code) and code.max() >> 24:
            raise ValueError("a text of more than 16 million different words")
        return np.ascontiguousarray(code.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).ravel()

    def load(self) -> bytes:
        changed = {"key": self.key.ravel(), "code": self._bytes(self.code), "live": np.diff(self.live, prepend=0), "gap": np.diff(self.gap, prepend=0)}
        return packed(*[changed.get(k, getattr(self, k)) for k in self.FIELDS])

    def asked(self, levels: tuple[int, ...] | None) -> tuple[np.ndarray, np.ndarray]:
        """Where the contexts end that this round asks for, and their lengths, 0 for none: rows of those of a level in ladders, of a quarter of each gap afterwards."""
        if levels is not None:
            where, n, far = self.live, np.repeat(np.asarray(levels, np.int64)[:, None], len(self.live), 1), self.far_live
        else:
            step = self.high - self.low
            n = np.stack([self.low + step * j // 4 for j in (1, 2, 3)])
            n[1:][n[1:] == n[:-1]] = 0
            n[n <= self.low] = 0
            where, far = self.gap, self.far
        n[n > far] = 0
        return np.broadcast_to(where, n.shape).ravel(), n.ravel()

    def _spent(self) -> np.ndarray:
        """Words that are scored and whose next word is, too."""
        done = (self.done == 1) | (self.place == 0)
        later = np.ones(len(done), bool)
        later[:-1] = done[1:]
        later[self.at[1:] - 1] = True  # what is no longer here is scored
        return done & later

    def most(self, spent: np.ndarray) -> np.ndarray:
        """The greatest length that each word's match can have still."""
        known = ~spent
        known[self.live] = False
        known[self.gap] = False
        bound = np.where(known, self.size, self.place + 1)
        if len(self.gap):
            top = np.zeros(len(bound), np.int64)
            np.maximum.at(top, self.gap, self.high)
            top[self.live] = 0
            some = np.flatnonzero(top)
            bound[some] = np.minimum(bound[some], np.maximum(top[some] - 1, self.size[some]))
        index = self.doc << 32
        index += self.place
        bound -= index
        np.minimum.accumulate(bound, out=bound)
        bound += index
        return bound

    def sorted(self, where: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the contexts of ``n`` words that end at ``where``: their order, the sorted keys, and which of these differ from the one before."""
        h = self.dictionary[self.code]
        power, inverse = _powers(len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[: len(h)], out=total[1:])
        key = np.empty(len(where), np.uint64)
        for i in range(0, len(where), _STEP):  # in steps that stay in the processor's cache
            end, size = where[i : i + _STEP] + 1, n[i : i + _STEP]
            begin = end - size
            x = total[end]
            x -= total[begin]
            x *= inverse[begin]
            key[i : i + _STEP] = mix(mix(x) + size.astype(np.uint64))
        return _order(key)

    @staticmethod
    def _words(dictionary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first round's contexts, single words, ascending, and their places in the dictionary."""
        key = mix(mix(dictionary) + np.uint64(1))
        o = np.argsort(key)
        return key[o], o

    def words_asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The first round's contexts (ascending), and their weighted number in the block."""
        key, o = self._words(self.dictionary)
        return key, np.bincount(self.code, self.weight[self.doc], len(key)).astype(np.int64)[o]

    @classmethod
    def told(cls, load: memoryview, totals: np.ndarray) -> tuple[bytes, int]:
        """The load of a block with the first round's answers, its other arrays as they are, and its number of words."""
        dictionary, at = (unpacked(load, only=cls.FIELDS.index(k))[0] for k in ("dictionary", "at"))
        _, o = cls._words(dictionary.astype(np.uint64))
        seen = np.empty(len(totals), np.int64)
        seen[o] = totals
        return bytes(load[: -len(packed(seen[:0]))]) + packed(seen), int(at[-1])

    def distinct(self, where: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct contexts (ascending) and their weighted number in the block."""
        o, key, new = self.sorted(where, n)
        first = np.flatnonzero(new)
        if (self.weight == 1).all():
            return key[first], _sizes(first, len(o))
        return key[first], np.add.reduceat(self.weight[self.doc[where]][o], first) if len(o) else first

    def shared(self, where: np.ndarray, n: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which contexts other documents hold too, their number in the corpus, and in other documents. totals: of each distinct context, ascending."""
        o, _, new = self.sorted(where, n)
        total = np.repeat(totals, _sizes(np.flatnonzero(new), len(o)))
        some = np.flatnonzero(total > 1)  # what occurs once is in one document
        o, total, new = o[some], total[some], new[some]
        doc = self.doc.astype(np.int32)[where][o]
        new[1:] |= doc[1:] != doc[:-1]
        own = _sizes(np.flatnonzero(new), len(o))
        others = total - np.repeat(own, own)
        some = np.flatnonzero(others)
        return o[some], total[some], others[some]

    def learn(self, levels: tuple[int, ...] | None, before: int, then: bool, n: np.ndarray, total: np.ndarray, others: np.ndarray) -> None:
        """Takes the counts of what was asked, in all and in other documents; 0 for what no other document holds. ``before``: the last level of the ladder before; ``then``: another one follows."""
        width, known = (len(levels), self.live) if levels is not None else (3, self.gap)
        n, total, others = (x.reshape(width, -1) for x in (n, total, others))
        shared = others > 0
        for n_, others_, shared_ in zip(n, others, shared):
            better = np.flatnonzero(shared_)
            better = better[n_[better] > self.size[known[better]]]
            word, long = known[better], n_[better]
            np.maximum.at(self.size, word, long)
            best = np.flatnonzero(self.size[word] == long)
            self.count[word[best]] = others_[better[best]]
        gaps, bounds, place = ("gap", "low", "high", "n_low", "n_high"), [], self.place[known]
        if levels is not None:
            none = np.zeros(len(known), np.int64)
            # what matches at the last level has the next one, which no document reaches, above it
            bounds = list(zip([before, *levels], [*levels, 2 * levels[-1]], [self.top, *total], [*total, none], [np.ones(len(known), bool), *shared]))
            bounds = bounds[:-1] if then else bounds
            old = [getattr(self, k) for k in gaps]
            self.live, self.top = (self.live[shared[-1]], total[-1][shared[-1]]) if then else (self.live[:0], self.top[:0])
        else:
            # what could not be asked, as it is the one before or goes beyond the start, bounds no gap
            at, t, s = self.low, self.n_low, np.ones(len(known), bool)
            step = self.high - self.low
            for j in range(3):
                there = self.low + step * (j + 1) // 4
                same = there == at
                t_, s_ = np.where(same, t, total[j]), np.where(same, s, shared[j])
                bounds.append((at, there, t, t_, s))
                at, t, s = there, t_, s_
            bounds.append((at, self.high, t, self.n_high, s))
            old = [self.gap[:0]] * 5
        now = [[x] for x in old]
        for low, high, n_low, n_high, open_ in bounds:
            some = np.flatnonzero(open_ & (high - low > 1) & (n_low != n_high) & (low <= place))
            for x, new in zip((known, low, high, n_low, n_high), now):
                new.append(x[some] if np.ndim(x) else np.full(len(some), x))
        for k, new in zip(gaps, now):
            setattr(self, k, np.concatenate(new))
        self.close()

    def close(self) -> None:
        """Drops gaps that cannot hold a match: no longer one than their lower end is possible."""
        if not len(self.gap):
            return
        still = self.low < self.most(self._spent())[self.gap]
        for k in ("gap", "low", "high", "n_low", "n_high"):
            setattr(self, k, getattr(self, k)[still])

    def settle(self, words: int) -> None:
        """Scores the words whose context and own match are known, and forgets what is needed no more. words: of the corpus."""
        n = len(self.code)
        known = np.ones(n, bool)
        known[self.live] = False
        known[self.gap] = False
        both = known.copy()
        both[1:] &= known[:-1]
        i = np.flatnonzero((self.place > 0) & (self.done == 0) & both)
        length, doc = self.size[i - 1], self.doc[i]
        c = np.where(length > 0, self.count[i - 1], words - self.words[doc])
        d = np.where(self.size[i] == length + 1, self.count[i], 0)
        logp = np.log(d + KAPPA / VOCABULARY) - np.log(c + KAPPA)
        self.sum = self.sum + np.bincount(doc, logp, len(self.sum))
        self.context = self.context + np.bincount(doc, length, len(self.sum))
        self.done[i] = 1
        spent = self._spent()
        most = self.most(spent)
        size = self.size[self.live]
        self.far = np.minimum(self.high, most[self.gap])
        self.far_live = np.minimum(most[self.live], np.where(size < LEVELS[-1][-1], 8 * size, most[self.live]))  # the next level is 8 times as long at most
        reach = np.zeros(n + 1, np.int64)  # the words that open contexts reach
        for where, far in ((self.live, most[self.live]), (self.gap, np.minimum(self.high, most[self.gap]))):
            reach += np.bincount(where + 1 - far, minlength=n + 1)
            reach -= np.bincount(where + 1, minlength=n + 1)
        reached = np.cumsum(reach[:-1]) > 0
        keep = reached | ~spent
        self.size[spent] = 0
        self.count[spent] = 0
        used = np.zeros(len(self.dictionary), bool)
        used[self.code[reached]] = True
        self.code = np.where(reached, np.cumsum(used)[self.code], 0)[keep]
        self.dictionary = np.r_[np.uint64(0), self.dictionary[used]]
        begins = keep.copy()
        begins[1:] &= ~keep[:-1]
        first = self.at[:-1]
        begins[first] = keep[first]
        begins = np.flatnonzero(begins)
        self.of, self.start = self.doc[begins], self.place[begins]
        index = np.cumsum(keep) - 1
        self.at = np.r_[index[begins], int(keep.sum())]
        self.size, self.count, self.done, self.live, self.gap = self.size[keep], self.count[keep], self.done[keep], index[self.live], index[self.gap]
        self._placed()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, words, longest, load. Batches: key (16 bytes), weight and text of different texts."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    k, base = 0, TaskContext.get().partitionId() << 32

    def flush() -> pa.RecordBatch:
        nonlocal k
        key, lengths, weight, h = (np.concatenate(x) for x in zip(*held))
        held.clear()
        k += 1
        said = int(((lengths - 1) * weight).sum()), int(lengths.max())
        return pa.RecordBatch.from_pydict({"block": [base + k], "words": [said[0]], "longest": [said[1]], "load": [Block.load_of(key, lengths, weight, h)]})

    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, 2)
        weights = batch.column(1).to_numpy()
        for i, data, off in blocks(batch.column(2)):
            h, _, _, at = word_hashes(data, off)
            lengths = np.diff(at)
            some = lengths > 0
            if some.any():
                h = np.insert(h, at[:-1][some], _START)
                held.append((keys[i : i + len(lengths)][some], lengths[some] + 1, weights[i : i + len(lengths)][some], h))
                if sum(len(x[3]) for x in held) >= BLOCK_WORDS:
                    yield flush()
    if held:
        yield flush()


def _planes(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, byte by byte."""
    return packed(np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).ravel())


def _from_planes(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(x.astype(np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _ask(levels: tuple[int, ...] | None, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """shard, block, load: the distinct contexts of each block for each shard, and their numbers."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_kept()
        for batch in batches:
            for block, load in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = Block(memoryview(load.as_buffer()), counts=False)
                if levels == LEVELS[0]:
                    key, weight = b.words_asked()
                else:
                    where, n = b.asked(levels)
                    key, weight = b.distinct(where[n > 0], n[n > 0])
                to = (key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
                cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
                ends = [*cut[1:], len(to)]
                loads = [len(p := _planes(key[s:e])).to_bytes(8, "little") + p + packed(weight[s:e]) for s, e in zip(cut, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(to[cut].astype(np.int64)), pa.array(np.full(len(cut), block)), pa.array(loads, pa.binary())], ["shard", "block", "load"])

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """The suffix array of a shard, and the width of each asked context's range in it."""
    memory_kept()
    asked, weights = [], []
    for x in table["load"]:
        load = memoryview(x.as_buffer())
        n = 8 + int.from_bytes(load[:8], "little")
        asked.append(_from_planes(unpacked(load[8:n])[0]))
        weights.append(unpacked(load[n:])[0])
    every, weight = np.concatenate(asked), np.concatenate(weights)
    o, _, new = _order(every)
    first = np.flatnonzero(new)
    width = np.empty(len(o), np.int64)
    width[o] = np.repeat(np.add.reduceat(weight[o], first), _sizes(first, len(o)))
    loads = [packed(x) for x in np.split(width, np.cumsum([len(x) for x in asked])[:-1])]
    return pa.table({"block": table["block"], "shard": table["shard"], "load": pa.array(loads, pa.binary())})


def _learn(levels: tuple[int, ...] | None, before: int, then: bool, words: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """block, load, open (contexts still asked for) from a block and its answers."""

    def learn(state: pa.Table, answers: pa.Table) -> pa.Table:
        memory_kept()
        load = memoryview(state["load"][0].as_buffer())
        parts = [unpacked(memoryview(answers["load"][int(k)].as_buffer()))[0] for k in np.argsort(answers["shard"].to_numpy())] if len(answers) else []
        totals = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        if levels == LEVELS[0]:
            told, asks = Block.told(load, totals)
            return pa.table({"block": state["block"], "load": pa.array([told], pa.binary()), "open": pa.array([3 * asks], pa.int64())})
        b = Block(load)
        where, n = b.asked(levels)
        ok = np.flatnonzero(n)
        at, *counts = b.shared(where[ok], n[ok], totals)
        total, others = np.zeros((2, len(n)), np.int64)
        at = ok[at]
        total[at], others[at] = counts
        b.learn(levels, before, then, n, total, others)
        b.settle(words)
        return pa.table({"block": state["block"], "load": pa.array([b.load()], pa.binary()), "open": pa.array([3 * (len(b.live) + len(b.gap))], pa.int64())})

    return learn


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for load in batch.column(0):
            b = Block(memoryview(load.as_buffer()))
            raw = np.ascontiguousarray(b.key).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[16 * k : 16 * k + 16] for k in range(len(b.key))], pa.binary()), pa.array(b.words), pa.array(b.sum), pa.array(b.context)], ["key", "n", "logp", "context"])


def _built(rows: DataFrame) -> tuple[DataFrame, str]:
    """The blocks of all different texts, and where they are kept."""
    different = rows.where("text IS NOT NULL").groupBy("key").agg(F.count("*").alias("weight"), F.first("text").alias("text"))
    return stored(different.select("key", "weight", "text").mapInArrow(_blocks, "block long, words long, longest long, load binary"), "block")


def _searched(table: DataFrame, ladders: list[tuple[int, ...]], round_: int, waiting: int, words: int) -> tuple[DataFrame, str]:
    """The blocks after one more round, and where they are kept."""
    levels = ladders[round_] if round_ < len(ladders) else None
    before, then = ladders[round_ - 1][-1] if 0 < round_ < len(ladders) else 0, round_ + 1 < len(ladders)
    asked = table.select("block", "load").mapInArrow(_ask(levels, max(1, waiting // SHARD_CONTEXTS)), "shard long, block long, load binary")
    answers = asked.groupBy("shard").applyInArrow(_answer, _ANSWER)
    learned = table.select("block", "load").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_learn(levels, before, then, words), "block long, load binary, open long")
    return stored(learned, "block")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_prob, perplexity, mean_context of every document with an id."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).where("doc_id IS NOT NULL")
    size = rows.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if size[0] != size[1]:
        rows = rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    rows = rows.select("doc_id", "text", F.unhex(F.md5("text")).alias("key"))
    table, path = _built(rows)
    released(spark)
    words, longest = table.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("longest"), F.lit(0))).first()
    more = [64]
    while 2 * more[-1] <= longest:
        more.append(2 * more[-1])
    ladders = [*LEVELS, tuple(more)]
    waiting, round_ = words, 0
    while waiting:
        old = path
        table, path = _searched(table, ladders, round_, waiting, words)
        discard(spark, old)
        waiting = table.agg(F.sum("open")).first()[0] or 0
        round_ += 1
    found = written(table.select("load").mapInArrow(_scored, "key binary, n long, logp double, context double"))
    discard(spark, path)
    n = F.coalesce("n", F.lit(0))
    return rows.select("doc_id", "key").join(found, "key", "left").select(
        "doc_id",
        n.alias("n_words"),
        F.coalesce("logp", F.lit(0.0)).alias("log_prob"),
        F.when(n > 0, F.exp(-F.col("logp") / n)).alias("perplexity"),
        F.when(n > 0, F.col("context") / n).alias("mean_context"),
    )
