"""The pipeline: each stage against a brute-force version of itself, on its own input."""

from collections import Counter

import numpy as np
import pytest
from test_operators import AWKWARD, EXTRA, brute_passages, groups_of, texts_of  # noqa: F401

import corpus_pipeline
from vecloom.llm import phrases, quality, secrets, simhash
from vecloom.llm.frames import written

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "secret_scan", "packing"]
    before = {r["doc_id"]: r for r in docs.collect()}
    reasons = {r["doc_id"]: r["reason"] for r in quality.judge(docs).collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SMALL))
        after = {r["doc_id"]: r for r in out.collect()} if name != "packing" else {}
        if name != "packing":
            assert out.columns == columns and out.dtypes == docs.dtypes and all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "quality_rules":
            assert set(after) == {i for i in before if reasons[i] is None}
        elif name == "near_dedup":
            prints = {r["doc_id"]: np.array([r["hi"], r["lo"]], np.int64).view(np.uint64) for r in simhash.fingerprints(docs).collect()}
            ids = sorted(before)
            edges = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if np.bitwise_count(prints[a] ^ prints[b]).sum() <= simhash.MAX_BITS]
            assert set(after) == {n for n, g in groups_of(edges, ids).items() if n == g}
        elif name == "substring_dedup":
            cut = Counter()
            for i, start, end, _, first in brute_passages({(i, r["text"]) for i, r in before.items()}, phrases.LENGTH):
                cut[i] += 0 if first else end - start
            for i, r in before.items():
                assert (i in after and len(after[i]["text"]) <= len(r["text"]) - cut[i]) if not cut[i] or i in after else len(r["text"].strip()) == cut[i]
                assert cut[i] or after[i] == r
        elif name == "secret_scan":
            assert set(after) == set(before)
            for i, r in before.items():
                text = r["text"]
                for rule, start, end, _ in reversed(secrets.scanner().find(text)):
                    text = f"{text[:start]}[{rule}]{text[end:]}"
                assert after[i]["text"] == text
        else:
            rows = out.collect()
            tokens = sum(len(r["text"].split()) for r in before.values())
            assert sum(r["n_tokens"] for r in rows) == tokens and {i for r in rows for i in r["doc_ids"]} == {i for i, r in before.items() if r["text"].split()}
        docs, before = out, after
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_awkward_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL))
    assert docs.count() == 0 if not rows else docs.count() > 0
