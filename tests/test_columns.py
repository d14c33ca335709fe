"""Column operators against the plain-string ones, SQL functions, retrieval, and the driver's contract."""

import importlib.util
import json
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vecloom import config as C
from vecloom import queries as Q
from vecloom.functions import sql
from vecloom.operators import chunking as K
from vecloom.operators import embedding as E
from vecloom.operators import errors as X
from vecloom.operators import text as T
from vecloom.operators.formatting import format_template
from vecloom.operators.nearest import nearest
from vecloom.plans import retrieval as R

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ODD = [
    None, "", " ", "\n\n", "a", "Hello world. How are you? Fine! Thanks.", "A. B. C. D. E. F.", "one\n\ntwo\n\n\nthree\n", "　wide . \x1c kept\x1c ", "x" * 50, "a. " * 40, "tab\ttab", "no end", "! ! ! ", ". ", "é. ü! ß? 日本。\n",
    "$1 \\d (a) [b] {c} * + ? ^ |",
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    return df.unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select((F.col("doc_id") + 1000).cast("int").alias("id"), "text")).repartition(3).cache()


@pytest.mark.parametrize(
    "cfg",
    [
        C.ChunkingNone(), C.ChunkingSentence(60, 0), C.ChunkingSentence(60, 35, min_characters_per_sentence=3), C.ChunkingSentence(20, 20, delimiters=("a", ". "), min_sentences_per_chunk=2), C.ChunkingCharacter(30, 0, "\n"),
        C.ChunkingCharacter(30, 12, " "), C.ChunkingCharacter(9, 9, ". "), C.ChunkingCharacter(20, 5, r"\s+", True), C.ChunkingCharacter(3, 1, ""), C.ChunkingRecursive(40, 10), C.ChunkingRecursive(10, 0, (r"\d+", " "), True),
        C.ChunkingSemchunk(30, 5), C.ChunkingSemchunk(30, 0, strict_mode=True), C.ChunkingSemantic(200, 20, 2, 1),
    ],
)
def test_chunkers(odd, cfg):
    embed = E.letter_embedder("eat").embed
    for r in odd.select("text", K.chunk_column(F.col("text"), cfg, embed).alias("c")).collect():
        if r["text"] is not None:
            assert r["c"] == sql.chunks_of(r["text"], cfg, embed), repr(r["text"])
        elif not isinstance(cfg, C.ChunkingNone):
            assert r["c"] is None


def test_trim_blank_and_tokens(odd):
    for r in odd.select("text", K.unicode_trim(F.col("text")).alias("t"), K.is_blank(F.col("text")).alias("b"), E.token_estimate(F.col("text")).alias("n")).collect():
        t = r["text"]
        assert r["t"] == (None if t is None else T.trim(t)) and r["b"] == (t is None or not T.trim(t))
        assert t is None or r["n"] == E.estimated_tokens(t)


def test_error_columns(spark):
    said = [*Q._MESSAGES, "HTTP 50 then HTTP 500", "status 429 and http 503", "Http 7 status 404", '{"CODE":"Up"}', "line\nHTTP 502 x"]
    m = F.col("m")
    for r in spark.createDataFrame([(x,) for x in said], "m string").select("m", X.message_is_transient(m).alias("t"), X.status_column(m).alias("s"), X.code_column(m).alias("c")).collect():
        assert (r["t"], r["s"], r["c"]) == (X.transient_message(r["m"]), X.status_in(r["m"]), X.code_in(r["m"])), r["m"]


def test_template(spark):
    df = spark.createDataFrame([(7, None, "see $name and $id2", True, [1, 2]), (8, "N", None, None, None)], "id int, name string, chunk string, ok boolean, xs array<int>")
    got = [r[0] for r in df.select(format_template(df, "$name|$id|$id2|$none|$ok|$xs: $chunk")).collect()]
    assert got == ["|7|72|$none|true|[1,2]: see  and 72", "N|8|82|$none||: "]
    assert [r[0] for r in df.select(format_template(df, "$name $chunk", fields=["id"])).collect()] == ["$name see $name and 72", "$name "]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 8)).astype(np.float32)
    x[40] = x[3]
    x[41] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<float>")
    y = x.astype(np.float64)
    n = np.linalg.norm(y, axis=1, keepdims=True)
    y = np.divide(y, n, out=np.zeros_like(y), where=n > 0)
    want = set()
    for q, row in enumerate(np.round(1 - y @ y.T, 9)):
        for k, i in enumerate(sorted(range(150), key=lambda i: (row[i], i))[:5]):
            want.add((q, i, k + 1))
    got = {(r["query_id"], r["neighbour_id"], r["rank"]) for r in nearest(df, df, 5, block=40).collect()}
    assert got == want and nearest(df.limit(0), df, 5).count() == 0
    per = R.top_k_per_query(df.where("vec_id < 150"), df.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 5, ["vec_id"])
    assert {(r["query_id"], r["rank"]) for r in per.collect()} == {(q, k) for q in range(3) for k in range(1, 6)}


def test_sql_functions(spark, odd):
    sql.register(spark)
    odd.createOrReplaceTempView("odd")
    cfg = json.dumps({"implementation": "sentence_chunker", "chunk_size": 60, "chunk_overlap": 0})
    a = Counter((r["id"], c) for r in spark.sql(f"SELECT id, chunk_text(text, '{cfg}') AS c FROM odd").collect() for c in r["c"] or [] if r["id"] >= 1000)
    b = Counter((r["id"], r["chunk"]) for r in spark.sql(f"SELECT id, chunk FROM odd, LATERAL chunks(text, '{cfg}') WHERE id >= 1000").collect())
    assert a == b and len(a) > 100
    (r,) = spark.sql("SELECT cosine_similarity(array(1f, 0f), array(1f, 1f)) AS a, cosine_similarity(array(0f), array(1f)) AS z, cosine_similarity(array(1f), array(1f, 2f)) AS n, token_estimate('abcde') AS t, unicode_trim('　a\\n') AS u").collect()
    assert r["a"] == pytest.approx(0.5**0.5) and r["z"] == 0 and r["n"] == 0 and r["t"] == 2 and r["u"] == "a"


def _plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    df = Q.queries()[name](spark, SMALL)
    cur = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(_plain(v) for v in row) for row in cur.fetchall())
    assert Counter(tuple(_plain(r[c]) for c in names) for r in df.collect()) == want


def test_recursive_and_hierarchy_queries(spark):
    """Chunks, order and overlap of the queries without SQL, text by text."""
    for name, chunk in (
        ("chunk_recursive", lambda t: T.recursive_chunks(t, 800, 400, C.RECURSIVE_SEPARATORS, False)), ("chunk_semchunk", lambda t: T.hierarchy_chunks(t, 500, 50)), ("chunk_semchunk_strict", lambda t: T.hierarchy_chunks(t, 500, 0, True)),
    ):
        key, table, text = ("page_id", "pages", "html") if name.endswith("strict") else ("doc_id", "documents", "text")
        want = Counter((r[0], k, c) for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(key, text).collect() for k, c in enumerate(chunk(r[1])))
        assert Counter(map(tuple, Q.queries()[name](spark, SMALL).select(key, "chunk_seq", "chunk").collect())) == want


def test_embedder_names_mean_one_embedder():
    mine = E.letter_embedder("xy")
    E.register_embedder("only mine", mine)
    E.register_embedder("only mine", mine)
    with pytest.raises(ValueError):
        E.register_embedder("only mine", E.letter_embedder("xyz"))


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(Q.queries()) <= set(entry.queries())
    if importlib.util.find_spec("vecloom.llm") and importlib.util.find_spec("corpus_pipeline"):
        assert "pipeline" in entry.queries()
