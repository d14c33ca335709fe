"""Mixture-controlled packing: deficit round-robin over the queues of the sources.

Each source is a queue of documents by id. A source with weight ``w`` earns ``w`` tokens of
credit per round and a document leaves its queue when its source's credit covers it; what
is left over, or lacking, is the deficit and is carried on. Document after document, in the
order in which they leave, the tokens fill windows of ``window`` tokens; a document is split
only where a window is full. So every window but the last is full, and up to any point
each source has had its share of the tokens but for one document's worth, until it runs dry.

The round in which a document leaves needs no simulation: with ``c`` tokens in its queue up to
and including it, its credit suffices from virtual time ``c / w`` on. Hence two distributed prefix sums, each
per bucket and then over the buckets' totals: tokens by source give ``c``, and tokens by
virtual time give the place in the stream. Deficits cross windows and partitions because both sums do. No source
and no stretch of the stream is ever held by one task, however hot.

A token is a run of characters other than blank, tab, CR and LF; a piece of text keeps its white space.

Defined results
* null, empty and blank texts have no tokens and are in no window;
* a null source is the queue ``''``; rows with a null id come first in their queue and are reported as null;
* ties: equal times go by source, then id (nulls first), then a hash of the text; repeated rows are packed as often as they occur;
* an empty table gives no windows; other columns are ignored; very long texts go on through as many windows as they need.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import texts, written

WINDOW = 2048
#: Rows, and windows' worth of tokens, in a bucket of the two prefix sums.
BUCKET_ROWS, BUCKET_WINDOWS = 20_000, 500
SEPARATOR = "\n\n"
_TOKEN = "[^ \\\\t\\\\r\\\\n]+"
_NO_ID = -(1 << 63)
_BIG = "decimal(38,0)"


def schedule(docs: DataFrame, weights: Mapping[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id0, source0, text_hash, tokens, at: where each document starts in the stream of all tokens. No text is moved."""
    base = texts(docs, id_col, text_col, [source_col]).select(
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("id0"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source0"),
        F.xxhash64("text").alias("text_hash"),
        F.expr(f"CAST(regexp_count(text, '{_TOKEN}') AS BIGINT)").alias("tokens"),
    )
    rows = written(base.where("tokens > 0"))
    by_source = rows.groupBy("source0").agg(F.sum("tokens").alias("total"))
    # one row of figures; ids below zero and gaps only change how even the buckets are
    size = rows.where(f"id0 <> {_NO_ID}").agg(F.count("*").alias("n"), F.min("id0").alias("low"), F.max("id0").alias("high"), F.sum("tokens").alias("t")).first()
    low, high = size["low"] or 0, size["high"] or 0
    width = max(1, (high - low + 1) * BUCKET_ROWS // max(size["n"], 1))
    rows = rows.withColumn("bucket", F.expr(f"CASE WHEN id0 = {_NO_ID} THEN -1L ELSE CAST((CAST(id0 AS {_BIG}) - {low}) div {width} AS BIGINT) END"))

    before = (Window.unboundedPreceding, -1)
    of_bucket = rows.groupBy("source0", "bucket").agg(F.sum("tokens").alias("s"))
    of_bucket = of_bucket.select("source0", "bucket", F.coalesce(F.sum("s").over(Window.partitionBy("source0").orderBy("bucket").rowsBetween(*before)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source0", "bucket").orderBy("id0", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("c", F.sum("tokens").over(inside)).join(of_bucket, ["source0", "bucket"]).withColumn("c", F.col("c") + F.col("base"))

    if weights is None:
        every = by_source.agg(F.sum("total").alias("every"))
        share = by_source.crossJoin(every).select("source0", F.col("total").alias("w"), "every")
    else:
        told = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)))]) if weights else F.create_map().cast("map<string,bigint>")
        share = by_source.select("source0", F.greatest(F.coalesce(told[F.col("source0")], F.lit(1)), F.lit(1)).cast("bigint").alias("w"), F.lit(max(1, sum(map(int, weights.values())))).cast("bigint").alias("every"))
    rows = rows.join(share, "source0").withColumn("time", F.expr(f"CAST((CAST(c AS {_BIG}) * every + w - 1) div w AS BIGINT)"))
    rows = rows.withColumn("slot", F.expr(f"time div {WINDOW * BUCKET_WINDOWS}L")).select("id0", "source0", "text_hash", "tokens", "time", "slot")

    of_slot = rows.groupBy("slot").agg(F.sum("tokens").alias("s"))
    of_slot = of_slot.select("slot", F.coalesce(F.sum("s").over(Window.orderBy("slot").rowsBetween(*before)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("slot").orderBy("time", "source0", "id0", "text_hash").rowsBetween(*before)
    return (
        rows.withColumn("at", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(of_slot, "slot")
        .select("id0", "source0", "text_hash", "tokens", (F.col("at") + F.col("base")).alias("at"))
    )


def pack(docs: DataFrame, weights: Mapping[str, int] | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """window_id, n_tokens, n_pieces, doc_ids, sources, text.

    ``weights``: a positive whole number for each source, 1 for those not named; None: the tokens each
    source has, so that all run dry together. doc_ids, sources and the pieces in text (parted by a blank line) are in stream order.
    """
    plan = schedule(docs, weights, id_col, text_col, source_col)
    piece = f"""transform(sequence(at div {window}L, (at + tokens - 1) div {window}L), w -> struct(
        w AS window_id, greatest(at, w * {window}L) AS at, greatest(w * {window}L - at, 0L) AS first, least((w + 1) * {window}L - at, tokens) AS last))"""
    # rows that are alike in all that matters share one entry, which lists the pieces of them all
    plan = plan.groupBy("id0", "source0", "text_hash").agg(F.flatten(F.collect_list(F.expr(piece))).alias("pieces"), F.max("tokens").alias("tokens"))
    body = texts(docs, id_col, text_col, [source_col]).where("text IS NOT NULL").select(
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("id0"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source0"),
        F.xxhash64("text").alias("text_hash"),
        "text",
    )
    body = body.groupBy("id0", "source0", "text_hash").agg(F.first("text").alias("text"))
    cut = body.join(plan, ["id0", "source0", "text_hash"]).select(
        "id0",
        "source0",
        F.when(F.expr("exists(pieces, p -> p.last - p.first < tokens)"), F.lit(None)).otherwise(F.col("text")).alias("whole"),
        F.when(F.expr("exists(pieces, p -> p.last - p.first < tokens)"), F.expr(f"regexp_extract_all(text, '[ \\\\t\\\\r\\\\n]*{_TOKEN}[ \\\\t\\\\r\\\\n]*', 0)")).alias("parts"),
        F.explode("pieces").alias("p"),
    )
    rows = cut.select(
        "p.window_id",
        F.struct(
            "p.at",
            F.when(F.col("id0") != _NO_ID, F.col("id0")).alias("doc_id"),
            F.col("source0").alias("source"),
            (F.col("p.last") - F.col("p.first")).alias("n"),
            F.coalesce("whole", F.expr("array_join(slice(parts, CAST(p.first AS INT) + 1, CAST(p.last - p.first AS INT)), '')")).alias("text"),
        ).alias("x"),
    )
    packed = rows.groupBy("window_id").agg(F.sum("x.n").alias("n_tokens"), F.count("*").alias("n_pieces"), F.array_sort(F.collect_list("x")).alias("x"))
    return packed.select(
        "window_id",
        "n_tokens",
        "n_pieces",
        F.col("x.doc_id").alias("doc_ids"),
        F.array_join("x.source", ",").alias("sources"),
        F.array_join("x.text", SEPARATOR).alias("text"),
    )


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL for :func:`pack` over ``documents`` (ids not repeated) with the default weights."""
    return rf"""WITH rows AS (
  SELECT doc_id, coalesce(source, '') AS source, text, regexp_extract_all(text, '[ \t\r\n]*[^ \t\r\n]+[ \t\r\n]*') AS parts FROM documents),
n AS (SELECT doc_id, source, parts, text, len(parts)::HUGEINT AS tokens FROM rows WHERE len(parts) > 0),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) AS c, sum(tokens) OVER (PARTITION BY source) AS w, sum(tokens) OVER () AS every FROM n),
a AS (SELECT *, (sum(tokens) OVER (ORDER BY (c * every + w - 1) // w, source, doc_id NULLS FIRST) - tokens)::BIGINT AS pos, tokens::BIGINT AS t FROM c),
p AS (SELECT *, unnest(generate_series(pos // {window}, (pos + t - 1) // {window})) AS window_id FROM a),
q AS (SELECT window_id, doc_id, source, greatest(pos, window_id * {window}) AS place, greatest(window_id * {window} - pos, 0) AS lo, least((window_id + 1) * {window} - pos, t) AS hi, t, text, parts FROM p)
SELECT window_id::BIGINT AS window_id, sum(hi - lo)::BIGINT AS n_tokens, count(*)::BIGINT AS n_pieces, list(doc_id ORDER BY place) AS doc_ids, string_agg(source, ',' ORDER BY place) AS sources,
  string_agg(CASE WHEN hi - lo = t THEN text ELSE array_to_string(parts[lo + 1:hi], '') END, chr(10) || chr(10) ORDER BY place) AS text
FROM q GROUP BY window_id"""
