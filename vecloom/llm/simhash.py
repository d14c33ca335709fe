"""Near-duplicates: 128-bit SimHash and a self-join of binary tries.

Fingerprint: each distinct word of a text votes on 128 bits with the weight
``sqrt(bytes - 0.5, 16 at most) * (1 + log2(count))``; long words say more about a text than
short ones. Two texts are near when their fingerprints differ in ``max_bits`` bits or fewer.

Join: the distinct fingerprints form a binary trie, and pairs of its nodes are walked
together from the root, bit by bit. A pair carries the number of bits in which the two paths
differ and is dropped as soon as that exceeds what is allowed at its depth. One trie would
allow ``max_bits`` from the first bit on and prune late, so there are eight, each
beginning at another of the eight 16-bit blocks and going round: whatever the places of the
differing bits, from one of the eight starts every first ``n`` blocks differ in
``n * max_bits / 8`` bits or fewer (else the deviations from that mean, summed round the
circle, could not come to zero or less), and that is the budget. No pair within ``max_bits`` is missed.

Distribution: a trie is cut at depth ``p`` into 2**p subtrees; each goes to one task with
copies of those before it that are within the first block's budget. Tasks send back
no pairs but a spanning forest of what they joined, so that a group of n copies makes n edges,
not n * n / 2; connected components of the forests are the groups.

Defined results
* null, empty and blank texts have no words and no fingerprint: they are nobody's duplicate;
* rows with a null id are nobody's duplicate; rows that repeat an id count once;
* equal fingerprints are at distance 0; of a group the smallest id stays;
* an empty table gives an empty result; other columns are ignored by :func:`duplicates` and kept by :func:`drop_duplicates`;
* texts are read whole at any length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import texts, written
from .textbytes import blocks, mix, word_hashes

MAX_BITS = 22
BLOCKS, WIDTH = 8, 16
#: Pairs of trie nodes with so few leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 64
#: Node pairs walked at a time.
FRONT = 1 << 16
#: Fingerprints in a subtree, about.
SUBTREE = 250_000


def fingerprints_of(h: np.ndarray, size: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """n x 2 words of 64 bits from word hashes, their sizes in bytes and the number (ascending) of the text of each."""
    out = np.zeros((n, 2), np.uint64)
    if not len(h):
        return out
    order = np.lexsort((h, doc))
    h, doc, size = h[order], doc[order], size[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    count = np.diff(np.r_[first, len(h)])
    h, doc, size = h[first], doc[first], size[first]
    weight = (np.sqrt(np.minimum(size, 16) - 0.5) * (1 + np.log2(count))).astype(np.float32)
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    total = np.add.reduceat(weight, begin)
    for k in range(2):
        bits = np.unpackbits(mix(h + np.uint64(k * 0x5851F42D)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        bits *= weight[:, None]
        ones = np.add.reduceat(bits, begin, axis=0)
        out[doc[begin], k] = np.packbits(ones * 2 > total[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, data, off in blocks(batch.column(1)):
            h, starts, ends, at = word_hashes(data, off)
            n = len(off) - 1
            fp = fingerprints_of(h, ends - starts, np.repeat(np.arange(n), np.diff(at)), n).view(np.int64)
            some = np.diff(at) > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, n).filter(pa.array(some)), pa.array(fp[some, 0]), pa.array(fp[some, 1])], ["doc_id", "hi", "lo"]
            )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hi, lo of the texts that have an id and a word."""
    rows = texts(docs, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, hi long, lo long")


def rotated(fp: np.ndarray, block: int) -> np.ndarray:
    """Fingerprints (n x 2) with their bits turned so that ``block`` comes first."""
    hi, lo = (fp[:, 0], fp[:, 1]) if block < 4 else (fp[:, 1], fp[:, 0])
    s = np.uint64(block % 4 * WIDTH)
    if not s:
        return np.stack([hi, lo], axis=1)
    t = np.uint64(64) - s
    return np.stack([hi << s | lo >> t, lo << s | hi >> t], axis=1)


def budget(depth: int, max_bits: int) -> int:
    """Differing bits allowed among the first ``depth``."""
    return max_bits * math.ceil(depth / WIDTH) // BLOCKS


def trie_join(a: np.ndarray, b: np.ndarray | None, max_bits: int, found: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Calls ``found`` with row numbers of near pairs of two tries, or of one with itself (b None).

    a, b: n x 2 fingerprints in ascending order, of one rotation. A node at depth d is a run of rows equal in d bits.
    """
    same = b is None
    b = a if b is None else b
    if not len(a) or not len(b):
        return
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def counts(d: int) -> tuple[np.ndarray, np.ndarray]:
        if d not in ones:
            each = []
            for x in (a,) if same else (a, b):
                c = np.zeros(len(x) + 1, np.int64)
                np.cumsum(x[:, d // 64] >> np.uint64(63 - d % 64) & np.uint64(1), out=c[1:], dtype=np.int64)
                each.append(c)
            ones[d] = each[0], each[-1]
        return ones[d]

    stack = [(0, *(np.array([x], np.int64) for x in (0, len(a), 0, len(b), 0)))]
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        if len(al) > FRONT:
            for k in range(0, len(al), FRONT):
                stack.append((d, *(x[k : k + FRONT] for x in (al, ah, bl, bh, err))))
            continue
        na, nb = ah - al, bh - bl
        leaf = (na * nb <= LEAF_PAIRS) | (d >= 64)
        if leaf.any():
            _leaves(a, b, same, al[leaf], na[leaf], bl[leaf], nb[leaf], max_bits, found)
            al, ah, bl, bh, err = (x[~leaf] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        ca, cb = counts(d)
        am, bm = ah - (ca[ah] - ca[al]), bh - (cb[bh] - cb[bl])
        most, parts = budget(d + 1, max_bits), []
        for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
            e = err + (x != y)
            p, q, r, s = (am, ah) if x else (al, am), (bm, bh) if y else (bl, bm), None, None
            ok = (e <= most) & (p[1] > p[0]) & (q[1] > q[0])
            if same and (x, y) == (1, 0):
                ok &= (al != bl) | (ah != bh)  # the mirror image of (0, 1)
            if ok.any():
                parts.append((p[0][ok], p[1][ok], q[0][ok], q[1][ok], e[ok]))
        if parts:
            stack.append((d + 1, *(np.concatenate(x) for x in zip(*parts))))


def _leaves(a: np.ndarray, b: np.ndarray, same: bool, al: np.ndarray, na: np.ndarray, bl: np.ndarray, nb: np.ndarray, max_bits: int, found: Callable) -> None:
    size = na * nb
    done = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=done[1:])
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + (1 << 21), "right")) - 1)
        node = np.repeat(np.arange(lo, hi), size[lo:hi])
        k = np.arange(done[lo], done[hi]) - done[node]
        i, j = al[node] + k // nb[node], bl[node] + k % nb[node]
        if same:
            ok = i != j
            ok &= (i < j) | (al[node] != bl[node]) | (na[node] != nb[node])
            i, j = i[ok], j[ok]
        for c in range(0, len(i), 1 << 20):
            x, y = i[c : c + (1 << 20)], j[c : c + (1 << 20)]
            near = np.bitwise_count(a[x, 0] ^ b[y, 0]) + np.bitwise_count(a[x, 1] ^ b[y, 1]) <= max_bits
            if near.any():
                found(x[near], y[near])
        lo = hi


class Forest:
    """Groups of 0..n-1 under joins, by hooking and pointer jumping."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.kept.append((i, j))
        self.pending += len(i)
        if self.pending > 1 << 20:
            self.settle()

    def settle(self) -> None:
        if not self.kept:
            return
        i, j = (np.concatenate(x) for x in zip(*self.kept))
        self.kept, self.pending = [], 0
        while True:
            x, y = self.root[i], self.root[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _scatter(p: int, max_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each fingerprint to its own subtree in each rotation, and to later ones within the first block's budget."""
    near = [x for x in range(1 << p) if x.bit_count() <= budget(p, max_bits)] if p <= WIDTH else []

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in (0, 1)], axis=1)
            rep = batch.column(2).to_numpy()
            task, own, load = [], [], []
            for block in range(BLOCKS):
                r = rotated(fp, block)
                home = (r[:, 0] >> np.uint64(64 - p)).astype(np.int64) if p else np.zeros(len(r), np.int64)
                rows = np.column_stack([r.view(np.int64), rep])
                for x in near:
                    to = home ^ x
                    sel = np.flatnonzero(to >= home)
                    sel = sel[np.argsort(to[sel], kind="stable")]
                    cut = np.flatnonzero(np.r_[True, to[sel][1:] != to[sel][:-1]]) if len(sel) else []
                    for s, e in zip(cut, [*cut[1:], len(sel)]):
                        task.append(block << 24 | int(to[sel[s]]))
                        own.append(not x)
                        load.append(rows[sel[s:e]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(task, pa.int64()), pa.array(own, pa.bool_()), pa.array(load, pa.binary())], ["task", "own", "load"])

    return scatter


def _join_task(max_bits: int) -> Callable[[pa.Table], pa.Table]:
    def join(table: pa.Table) -> pa.Table:
        own = table["own"].to_numpy(zero_copy_only=False)
        load = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 3) for x in table["load"]]

        def side(which: bool) -> np.ndarray:
            rows = [x for x, o in zip(load, own) if o == which]
            rows = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
            return rows[np.lexsort((rows[:, 1].view(np.uint64), rows[:, 0].view(np.uint64)))]

        a, b = side(True), side(False)
        forest = Forest(len(a) + len(b))
        fa, fb = (np.ascontiguousarray(x[:, :2]).view(np.uint64) for x in (a, b))
        trie_join(fa, None, max_bits, forest.add)
        trie_join(fa, fb, max_bits, lambda i, j: forest.add(i, j + len(a)))
        forest.settle()
        rep = np.r_[a[:, 2], b[:, 2]]
        joined = np.flatnonzero(forest.root != np.arange(len(rep)))
        return pa.table({"u": rep[joined], "v": rep[forest.root[joined]]}, pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return join


def components(edges: DataFrame) -> DataFrame:
    """node, root of the connected components of (u, v): alternating stars until nothing changes.

    root is the smallest node. Each round is written to the shared folder, so the plan doesn't grow.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(edges)
    while before[0]:
        two = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = two.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.*").where("u <> v").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, duplicate_of: every text that goes, and the text of its group that stays."""
    prints = written(fingerprints(docs, id_col, text_col))
    distinct = written(prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")))
    n = distinct.count()
    p = min(WIDTH, max(2, math.ceil(math.log2(max(n, 1) / SUBTREE)) if n else 2))
    sent = distinct.mapInArrow(_scatter(p, max_bits), "task long, own boolean, load binary")
    # one task per subtree: hashing alone would put several of these few heavy keys together
    tasks = BLOCKS << p
    spread = sent.repartition(min(tasks, max(4 * docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "task")
    edges = spread.groupBy("task").applyInArrow(_join_task(max_bits), "u long, v long")
    groups = components(edges)
    reps = distinct.join(groups, distinct.rep == groups.node, "left").select("hi", "lo", F.coalesce("root", "rep").alias("kept"))
    return prints.distinct().join(reps, ["hi", "lo"]).where("doc_id <> kept").select("doc_id", F.col("kept").alias("duplicate_of"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each group; rows that repeat the id of a kept one all stay."""
    gone = duplicates(docs, id_col, text_col, max_bits).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[f"`{id_col}`"].cast("long") == gone["__gone"], "left_anti")
