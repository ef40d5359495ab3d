"""The registered queries on the smallest tables, against DuckDB or the plain versions."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import decontaminate, jaccard, line_dedup, pii, quality, queries, suffix_dedup

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = duck.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_personal_data(spark, documents):
    got = {r["doc_id"]: r for r in queries.op2_personal_data(spark, DIR).collect()}
    for i, t in documents:
        base = pii.brute_force(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        joined = [f"{k}:{s}:{e}" for k, s, e in sorted(base, key=lambda x: (pii.ALL.index(x[0]), x[1]))]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = [x.split(":") for x in got[i]["spans"].split(",") if x]
        order = [(pii.ALL.index(k), int(s), int(e)) for k, s, e in spans]
        assert set(joined) <= {":".join(x) for x in spans} and order == sorted(order)
        assert all(int(s) < int(e) <= len(t) for _, s, e in spans)
        # secrets planted in clear
        assert {m.span(1) for m in re.finditer('token = "([0-9a-f]{40})"', t or "")} <= {(int(s), int(e)) for k, s, e in spans if k == "secret"}


def test_quality(spark, duck):
    got = {r["doc_id"]: r for r in queries.op3_quality(spark, DIR).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, y in duck.sql("SELECT doc_id, quality FROM labels").fetchall() if got[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.8 * len(held)


def test_suffix_dedup(spark, documents):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op9_suffix_dedup(spark, DIR).collect()}
    want = suffix_dedup.brute_force([t for _, t in documents])
    assert [got[i] for i, _ in documents] == want and any(w[1] for w in want)


def test_tokens_equal_the_libraries(spark, documents):
    """The registered queries of tokens and pieces against the libraries, document by document."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    coded = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in documents}
    start, want = 0, {}
    for i, _ in documents:
        ids = np.array([*coded[i], 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op1_token_store(spark, DIR).collect()} == want
    counted = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op7_token_counts(spark, DIR).collect()}
    assert counted == {i: (len((t or "").encode()), len(coded[i]), len(coded[i]) > 512) for i, t in documents}
    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    crc = {i: zlib.crc32(np.array(pieces.encode(t or ""), "<u4").tobytes()) for i, t in documents}
    assert {r["doc_id"]: r["ids_crc32"] for r in queries.op4_pieces(spark, DIR).collect()} == crc


def test_pipeline(spark, documents):
    """Every stage on its own input against the plain version, and the whole."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    before = documents
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]
    for j, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = queries.common.stored(stage(spark, docs, DIR), "test")
        if j == 0:
            model = quality.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
            want = {r["doc_id"]: r["text"] for r in quality.score(docs, model).where("score >= 0.3").collect()}
        elif j == 1:
            want = {i: t for i, t, n, gone in line_dedup.brute_force(before) if n == 0 or gone < n}
        elif j == 2:
            want = {i: dict(before)[i] for i, _, c in jaccard.brute_force(before, 5, 80) if i == c}
        elif j == 3:
            want = {i: dict(before)[i] for i, _, hit, _ in decontaminate.brute_force(before, items) if not hit}
        if j < 4:
            assert out.columns == docs.columns and out.where(F.col("n_chars") != F.length("text")).count() == 0
            before = sorted((r["doc_id"], r["text"]) for r in out.collect())
            assert dict(before) == want and len(want) < 200
            docs = out
    assert out.count() == len(before) and out.where("NOT round_trip").count() == 0
    whole = corpus_pipeline.run(spark, DIR)
    assert sorted(r["doc_id"] for r in whole.collect()) == [i for i, _ in before]


def test_pipeline_on_empty_and_null_rows(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "a b c", "en", "s", 5)], docs.schema)
    for start in (docs.limit(0), docs.limit(20).unionByName(extra)):
        x = start
        for _, stage in corpus_pipeline.STAGES:
            x = queries.common.stored(stage(spark, x, DIR), "edge")
        assert x.count() <= start.count()
