"""Language identification by error-correcting output codes.

Every language has a codeword of some bits, and for every bit a binary classifier over
hashed byte n-grams (1 to 4 bytes, naive Bayes log-odds) says which half of the languages a text is like. A text's
margin on a bit is the mean log-odds of its n-grams. Decoding is loss-weighted: a codeword's loss is
the sum over bits of ``weight * log2(1 + exp(-margin * bit / scale))``, weights and scales being each classifier's
accuracy above chance and mean absolute margin on a held-out part of the sample; the codeword of least loss
wins. A text is flagged ambiguous when the runner-up's loss is within ``gap`` of the winner's (as a share of
the total weight), or when there is nothing to decide by.

Codewords: all distinct splits of the languages where they are few (up to 5 languages), else random
dense ones with the greatest least distance of 200 draws.

The classifiers are fitted on a bounded sample, ``per_language`` labelled rows of each language at
most, those with the smallest hash of id; identification reads all rows whole.

Defined results
* null, empty and blank texts, and texts of whatever kind when the sample has no or one language: lang ``und`` or
  that one, margin 0, ambiguous;
* a null label is no sample row; a null id is reported as null; repeated rows are each identified;
* ties: the language that comes first by name; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import texts
from .textbytes import blocks

PER_LANGUAGE = 400
GRAMS = (1, 2, 3, 4)
TABLE_BITS = 15
GAP = 0.05
SEED = 11


def codewords(k: int) -> np.ndarray:
    """k x bits of -1 and 1, no column constant."""
    if k <= 5:
        columns = [c for c in itertools.product((-1, 1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(columns or [(1,) * k], np.int8).T
    rng, best, far = np.random.default_rng(SEED), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (k, math.ceil(10 * math.log2(k))))
        code = code[:, np.abs(code.sum(axis=0)) < k]
        near = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        if near > far:
            best, far = code, near
    return best


def gram_slots(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size, table slots and text numbers. ASCII capitals count as small; digits and signs don't count; n-grams don't cross texts."""
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    letter = (lower >= 97) & (lower <= 122) | (lower >= 128)
    x = np.where(letter, lower, np.uint8(32)).astype(np.uint32)
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    h = np.zeros(len(x), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        h = (h[: len(x) - n + 1] * np.uint32(257) + x[n - 1 :]) if n > 1 else x.copy()
        if n in GRAMS and len(h):
            ok = (doc[: len(h)] == doc[n - 1 :]) & letter[: len(h)]
            yield ((h[ok] * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - TABLE_BITS)), doc[: len(h)][ok]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    code: np.ndarray
    odds: np.ndarray  # table slots x bits
    weight: np.ndarray
    scale: np.ndarray

    def margins(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """texts x bits, and the number of n-grams of each text."""
        n, bits = len(off) - 1, self.odds.shape[1]
        total, count = np.zeros((n, bits)), np.zeros(n, np.int64)
        for slot, doc in gram_slots(data, off):
            if not len(slot):
                continue
            begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            at = doc[begin]
            count[at] += np.diff(np.r_[begin, len(doc)])
            for b in range(bits):
                total[at, b] += np.add.reduceat(self.odds[:, b][slot], begin, dtype=np.float64)
        return total / np.maximum(count, 1)[:, None], count

    def decode(self, margin: np.ndarray, count: np.ndarray, gap: float = GAP) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, loss gap to the runner-up (share of the total weight) and whether ambiguous, of each text."""
        k = len(self.langs)
        if k < 2:
            one = self.langs[0] if k else "und"
            return [one if c else "und" for c in count], np.zeros(len(count)), np.ones(len(count), bool)
        z = margin / self.scale
        loss = np.stack([(self.weight * np.logaddexp(0, -z * word)).sum(axis=1) for word in self.code], axis=1) / math.log(2) / self.weight.sum()
        order = np.argsort(loss, axis=1, kind="stable")
        ahead = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - np.take_along_axis(loss, order[:, :1], 1)[:, 0]
        ahead = np.where(count > 0, ahead, 0.0)
        return [self.langs[i] if c else "und" for i, c in zip(order[:, 0], count)], ahead, (ahead < gap) | (count == 0)


def fit(sample: list[tuple[str, str]]) -> Model:
    """From (language, text) pairs: every fifth of a language measures, the others are learned from."""
    langs = tuple(sorted({lang for lang, _ in sample}))
    code = codewords(len(langs)) if langs else np.zeros((0, 1), np.int8)
    size = 1 << TABLE_BITS
    counts = np.zeros((len(langs), size))
    held: list[tuple[int, str]] = []
    seen = dict.fromkeys(langs, 0)
    for lang, text in sample:
        seen[lang] += 1
        if seen[lang] % 5 == 0:
            held.append((langs.index(lang), text))
            continue
        for _, data, off in blocks(pa.array([text], pa.large_string())):
            for slot, _ in gram_slots(data, off):
                counts[langs.index(lang)] += np.bincount(slot, minlength=size)
    share = (counts + 0.1) / (counts + 0.1).sum(axis=1, keepdims=True)
    odds = np.zeros((size, code.shape[1]), np.float32)
    for b in range(code.shape[1] if len(langs) > 1 else 0):
        up, down = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
        odds[:, b] = np.log(up / down)
    bits = code.shape[1]
    model = Model(langs, code, odds, np.ones(bits), np.ones(bits))
    if held and len(langs) > 1:
        parts = [model.margins(data, off) for _, data, off in blocks(pa.array([t for _, t in held], pa.large_string()))]
        margin, count = np.concatenate([m for m, _ in parts]), np.concatenate([c for _, c in parts])
        truth = code[[i for i, _ in held]][count > 0]
        margin = margin[count > 0]
        if len(margin):
            right = (margin * truth > 0).mean(axis=0)
            model = Model(langs, code, odds, np.maximum(2 * right - 1, 0.01), np.maximum(np.abs(margin).mean(axis=0), 1e-6))
    return model


def sample_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """The bounded sample; ids are chosen from the narrow columns, so only one pass reads texts."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("doc_id IS NOT NULL AND lang IS NOT NULL").distinct()
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = narrow.withColumn("k", F.row_number().over(by)).where(F.col("k") <= per_language).select("doc_id", "lang", "k")
    rows = texts(docs, id_col, text_col, [lang_col]).select("doc_id", "text", F.col(f"`{lang_col}`").cast("string").alias("lang"))
    # per_language rows for each language at most: bounded, whatever the table's size
    found = rows.where("text IS NOT NULL").join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "k", "doc_id", "text")
    return [(r["lang"], r["text"]) for r in sorted(found.dropDuplicates(["lang", "doc_id"]).collect(), key=lambda r: (r["lang"], r["k"]))]


def _identify(model: Model, gap: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, off in blocks(batch.column(1)):
                langs, ahead, unsure = model.decode(*model.margins(data, off), gap)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(off) - 1), pa.array(langs, pa.string()), pa.array(ahead, pa.float64()), pa.array(unsure, pa.bool_())], ["doc_id", "lang", "margin", "ambiguous"]
                )

    return identify


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, gap: float = GAP) -> DataFrame:
    """doc_id, lang, margin, ambiguous. Without a model, one is fitted on a sample of ``docs`` by ``lang_col``."""
    model = model or fit(sample_of(docs, id_col, text_col, lang_col, per_language))
    return texts(docs, id_col, text_col).mapInArrow(_identify(model, gap), "doc_id long, lang string, margin double, ambiguous boolean")
