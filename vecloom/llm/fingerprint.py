"""Document fingerprints: a Merkle tree of paragraphs, sections and document.

A paragraph is a line. A section ends at a blank line, before a heading (a line that begins with ``#``),
and after a paragraph whose hash begins with the digit 0, one in sixteen: the last rule gives long plain texts
sections too, and an edit moves no borders but those it touches. Hashes are SHA-256 in hex, told
apart by level: ``P`` + paragraph, ``S`` + its paragraphs' hashes, ``D`` + its sections' hashes. Of a root all 256 bits
are kept; to compare branches, the first 128 of a section's hash and, between two documents only, the first 64 of a paragraph's.
Equal roots mean equal texts. Where roots differ, only sections whose hashes differ are opened, and in them only
paragraphs whose hashes differ: those are the edits.

Defined results
* a null text has a null root, no sections, no original; the empty text has one section of one empty paragraph;
* rows with a null id have a fingerprint but are nobody's original or base; repeated ids are reported as often as they occur;
* ties: of equal texts the smallest id is the original, and of several bases the smallest id is taken;
* an empty table gives an empty result; other columns are ignored; texts are hashed whole at any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import texts, written


def trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, root, sections (their hashes), paragraphs (for each section its paragraphs' hashes, joined by commas). A map, no shuffle."""
    # z: blank, h: heading, g: any other; none is a hex digit
    kind = "CASE WHEN trim(p) = '' THEN 'z' WHEN startswith(p, '#') THEN 'h' ELSE 'g' END"
    marked = f"array_join(transform(split(text, '\\n', -1), p -> concat({kind}, sha2(concat('P', p), 256))), ',')"
    parted = f"replace(regexp_replace({marked}, '(z[0-9a-f]{{64}}|[gh]0[0-9a-f]{{63}}),', '$1;'), ',h', ';h')"
    rows = texts(docs, id_col, text_col).select("doc_id", F.expr(f"split(translate({parted}, 'ghz', ''), ';')").alias("paragraphs"))
    rows = rows.select("doc_id", "paragraphs", F.transform("paragraphs", lambda s: F.sha2(F.concat(F.lit("S"), s), 256)).alias("sections"))
    return rows.select("doc_id", F.sha2(F.concat(F.lit("D"), F.array_join("sections", ",")), 256).alias("root"), "sections", "paragraphs")


def packed(tree: DataFrame) -> DataFrame:
    """A tree as it is kept and moved: root in 32 bytes, sections in 16 each, and of each section its paragraphs in 8 each, one after the other."""
    return tree.select(
        "doc_id",
        F.unhex("root").alias("root"),
        F.expr("transform(sections, s -> unhex(left(s, 32)))").alias("sections"),
        F.expr("transform(paragraphs, s -> unhex(regexp_replace(s, '([0-9a-f]{16})[0-9a-f]{48},?', '$1')))").alias("paragraphs"),
    )


def _hashes(paragraphs: str) -> str:
    """The hashes in the packed paragraphs of a section."""
    return f"transform(sequence(1, octet_length({paragraphs}), 8), i -> substring({paragraphs}, i, 8))"


def edits(pairs: DataFrame) -> DataFrame:
    """key, section, paragraph (from 0) of what ``sections``/``paragraphs`` have and ``base_sections``/``base_paragraphs`` lack.

    pairs: key and both trees, packed. Branches with equal hashes aren't opened.
    """
    differing = pairs.where(F.size(F.array_except("sections", "base_sections")) > 0)
    mine = differing.select("key", F.array_except("sections", "base_sections").alias("new"), F.posexplode(F.arrays_zip("sections", "paragraphs")).alias("section", "x"))
    mine = mine.where(F.array_contains("new", F.col("x.sections"))).select("key", "section", F.col("x.paragraphs").alias("p"))
    mine = mine.select("key", "section", F.posexplode(F.expr(_hashes("p"))).alias("paragraph", "h"))
    there = differing.select("key", F.explode(F.array_distinct(F.flatten(F.expr(f"transform(base_paragraphs, s -> {_hashes('s')})")))).alias("h"))
    return mine.join(there, ["key", "h"], "left_anti").select("key", "section", "paragraph")


def compare(left: DataFrame, right: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section, paragraph of what each document of ``left`` has that its version in ``right`` lacks; ids not null and not repeated."""
    a, b = packed(trees(left, id_col, text_col)), packed(trees(right, id_col, text_col))
    b = b.select("doc_id", F.col("root").alias("base_root"), F.col("sections").alias("base_sections"), F.col("paragraphs").alias("base_paragraphs"))
    pairs = a.join(b, "doc_id").where("root <> base_root").withColumnRenamed("doc_id", "key")
    return edits(pairs).withColumnRenamed("key", "doc_id")


def nearest_by_paragraphs(own: DataFrame) -> DataFrame:
    """doc_id, root, f (id and root): of the texts with smaller ids that have half of a text's distinct paragraphs at least, the one that has most; ties by id.

    own: packed trees of different roots. Empty paragraphs don't count. A text that shares half of its n paragraphs shares one of any n div 2 + 1,
    so only its rarest ones are looked up. Texts of nothing but common paragraphs still meet in pairs.
    """
    every = F.array_distinct(F.flatten(F.expr(f"transform(paragraphs, s -> {_hashes('s')})")))
    sets = written(own.select("doc_id", "root", F.filter(every, lambda h: h != F.expr("substring(unhex(sha2('P', 256)), 1, 8)")).alias("hs")))
    lines = sets.select("doc_id", "root", F.size("hs").alias("n"), F.explode("hs").alias("h"))
    lines = lines.join(lines.groupBy("h").agg(F.count("*").alias("often")), "h")
    lines = written(lines.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy("often", "h"))).where("often > 1"))
    there = lines.select("h", F.struct("doc_id", "root").alias("f"))
    pairs = lines.where("rank <= n div 2 + 1").join(there, "h").where("f.doc_id < doc_id").select("root", "f").distinct()
    pairs = pairs.join(sets, "root").join(sets.select(F.struct("doc_id", "root").alias("f"), F.col("hs").alias("base_hs")), "f")
    shared = pairs.select("doc_id", "root", "f", F.size("hs").alias("n"), F.size(F.array_intersect("hs", "base_hs")).alias("shared"))
    best = shared.where("2 * shared >= n").groupBy("doc_id", "root").agg(F.min(F.struct(-F.col("shared"), "f")).alias("best"))
    return best.select("doc_id", "root", "best.f")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_paragraphs: bool = False) -> DataFrame:
    """doc_id, root, n_sections, n_paragraphs, original, n_copies, base, edits.

    original, n_copies: the smallest id with this root, and the number of rows with it. base: the smallest id, below
    the original's, of another root that shares a section, -1 if there is none; edits: ``section.paragraph`` of what is not in the base, in order.
    by_paragraphs: the base is that of :func:`nearest_by_paragraphs`, and the one above where that finds none.
    """
    tree = written(packed(trees(docs, id_col, text_col)))
    size = F.expr("aggregate(paragraphs, 0L, (n, s) -> n + octet_length(s) div 8)")
    small = tree.select("doc_id", "root", F.size("sections").cast("long").alias("n_sections"), size.alias("n_paragraphs"))
    roots = tree.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("original"), F.count("*").alias("n_copies"))
    # of rows with one root and id any will do; a map side combine keeps copies from being moved
    own = written(tree.where("root IS NOT NULL AND doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "sections", "paragraphs")).alias("o")).select("root", "o.*"))
    held = own.select("doc_id", "root", F.explode(F.array_distinct("sections")).alias("section"))
    first = held.groupBy("section").agg(F.min(F.struct("doc_id", "root")).alias("f"))
    base = held.join(first, "section").where("f.doc_id < doc_id").groupBy("doc_id", "root").agg(F.min("f").alias("f"))
    if by_paragraphs:
        near = nearest_by_paragraphs(own).withColumnRenamed("f", "near")
        base = base.join(near, ["doc_id", "root"], "full").select("doc_id", "root", F.coalesce("near", "f").alias("f"))
    base = written(base)
    other = own.select(F.struct("doc_id", "root").alias("f"), F.col("sections").alias("base_sections"), F.col("paragraphs").alias("base_paragraphs"))
    pairs = own.join(base, ["doc_id", "root"]).join(other, "f").select("root", "sections", "paragraphs", "base_sections", "base_paragraphs")
    found = edits(pairs.withColumnRenamed("root", "key")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("section", "paragraph"))).alias("e"))
    said = F.array_join(F.transform("e", lambda x: F.concat_ws(".", x["section"], x["paragraph"])), ",")
    found = found.select(F.col("key").alias("root"), said.alias("edits"))
    of_root = roots.join(base.select("root", F.col("f.doc_id").alias("base")), "root", "left").join(found, "root", "left")
    of_root = of_root.select("root", "original", "n_copies", "base", F.when(F.col("base").isNotNull(), F.coalesce("edits", F.lit(""))).alias("edits"))
    return small.join(of_root, "root", "left").select(
        "doc_id", F.lower(F.hex("root")).alias("root"), "n_sections", "n_paragraphs", "original", "n_copies", F.coalesce("base", F.lit(-1)).cast("long").alias("base"), "edits"
    )


def oracle() -> str:
    """DuckDB SQL for :func:`fingerprints` over ``documents`` (ids not null and not repeated)."""
    return r"""WITH m AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda p:
    CASE WHEN trim(p) = '' THEN 'z' WHEN starts_with(p, '#') THEN 'h' ELSE 'g' END || sha256('P' || p)), ',') AS marked FROM documents),
p AS (SELECT doc_id, string_split(translate(replace(regexp_replace(marked, '(z[0-9a-f]{64}|[gh]0[0-9a-f]{63}),', '\1;', 'g'), ',h', ';h'), 'ghz', ''), ';') AS paragraphs FROM m),
s AS (SELECT doc_id, paragraphs, list_transform(paragraphs, lambda x: sha256('S' || x)) AS sections FROM p),
t AS (SELECT doc_id, sha256('D' || array_to_string(sections, ',')) AS root, sections, paragraphs, len(sections) AS n_sections,
  len(string_split(array_to_string(paragraphs, ','), ',')) AS n_paragraphs FROM s),
r AS (SELECT root, min(doc_id) AS original, count(*) AS n_copies FROM t WHERE root IS NOT NULL GROUP BY root),
own AS (SELECT t.* FROM t JOIN r ON t.root = r.root AND t.doc_id = r.original),
held AS (SELECT DISTINCT doc_id, root, unnest(sections) AS section FROM own),
f AS (SELECT section, min(doc_id) AS f FROM held GROUP BY section),
b AS (SELECT h.doc_id, h.root, min(f.f) AS base FROM held h JOIN f USING (section) WHERE f.f < h.doc_id GROUP BY 1, 2),
pairs AS (SELECT b.root, o.sections, o.paragraphs, x.sections AS bs, string_split(array_to_string(x.paragraphs, ','), ',') AS bp FROM b JOIN own o ON o.doc_id = b.doc_id JOIN own x ON x.doc_id = b.base),
i AS (SELECT *, unnest(range(len(sections))) AS section FROM pairs),
j AS (SELECT *, unnest(range(len(string_split(paragraphs[section + 1], ',')))) AS paragraph FROM i WHERE NOT list_contains(bs, sections[section + 1])),
e AS (SELECT root, string_agg(section || '.' || paragraph, ',' ORDER BY section, paragraph) AS edits FROM j WHERE NOT list_contains(bp, string_split(paragraphs[section + 1], ',')[paragraph + 1]) GROUP BY root)
SELECT t.doc_id, t.root, t.n_sections::BIGINT AS n_sections, t.n_paragraphs::BIGINT AS n_paragraphs, r.original, r.n_copies, coalesce(b.base, -1) AS base,
  CASE WHEN b.base IS NOT NULL THEN coalesce(e.edits, '') END AS edits
FROM t LEFT JOIN r ON t.root = r.root LEFT JOIN b ON t.root = b.root LEFT JOIN e ON t.root = e.root"""
