"""Null and repeated rows, empty tables, clashing columns and ids that are no integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, jaccard, line_dedup, pii, quality, suffix_dedup, token_counts
from strandloom.llm.piece_fst import decode_pieces, encode_pieces, round_trips
from strandloom.llm.queries import tokenizer_path

MODEL = (np.zeros(1 << 17), 0.5)
ADDING = {
    "score": lambda d: quality.score(d, MODEL),
    "n_removed": line_dedup.dedup_lines,
    "N_Hit": lambda d: decontaminate.find_leaks(d, d.select(F.lit(1).alias("item_id"), "text")),
}


@pytest.mark.parametrize("name", sorted(ADDING))
def test_clashing_columns_are_refused(spark, name):
    docs = spark.createDataFrame([(1, "a b", 5)], f"doc_id long, text string, {name} int")
    with pytest.raises(ValueError, match=name):
        ADDING[name](docs)
    assert ADDING[name](docs.drop(name)).count() == 1


@pytest.mark.parametrize("run", [jaccard.jaccard_join, line_dedup.dedup_lines, suffix_dedup.remove_repeats, lambda d: token_counts.token_counts(d, tokenizer_path())])
def test_ids_must_be_integers(spark, run):
    with pytest.raises(TypeError, match="doc_id"):
        run(spark.createDataFrame([("x1", "a b")], "doc_id string, text string"))


def test_pieces_of_odd_rows(spark):
    """Repeated rows agree, nulls and empty texts have no pieces, empty tables no rows; a very long word is encoded whole."""
    path = tokenizer_path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None), (3, ""), (4, "qx" * 20_000)], "doc_id long, text string").repartition(2)
    rows = encode_pieces(docs, path).collect()
    assert len({tuple(r["ids"]) for r in rows if r["doc_id"] in (1, None)}) == 1 and {len(r["ids"]) for r in rows if r["doc_id"] in (2, 3)} == {0}
    trips = round_trips(docs, path)
    assert trips.count() == 6 and trips.where("round_trip").count() == 6
    back = {(r["doc_id"], r["text"]) for r in decode_pieces(encode_pieces(docs, path), path).collect()}
    assert back == {(1, "a b"), (None, "a b"), (2, ""), (3, ""), (4, "qx" * 20_000)}
    assert encode_pieces(docs.limit(0), path).count() == round_trips(docs.limit(0), path).count() == decode_pieces(encode_pieces(docs.limit(0), path), path).count() == 0


def test_keep_first_of_odd_rows(spark):
    """Repeated rows of the id that stays all stay, and an empty table stays empty."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None), (4, "")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in jaccard.keep_first(docs).collect()) == [0, 1, 1, 3, 4]
    assert jaccard.keep_first(docs.limit(0)).count() == 0


def test_quality_steps_follow_the_gradient():
    """One step from a plain model moves vectors along the numerical gradient of the softmax loss."""
    s = quality.Settings(bits=5, dim=3, epochs=1, rate=1e-3)
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (32, s.dim)).astype(np.float32).astype(float)
    out = rng.normal(0, 0.1, (2, s.dim))
    ids, share, label = np.array([3, 7, 20]), np.array([0.5, 0.3, 0.2]), 1

    def loss(v):
        z = out @ (share @ v[ids]) + np.log([1 - 0.99, 0.99])
        return np.log(np.exp(z).sum()) - z[label]

    numeric = np.zeros_like(vectors)
    for at in np.ndindex(*vectors.shape):
        moved = vectors.copy()
        moved[at] += 1e-6
        numeric[at] = (loss(moved) - loss(vectors)) / 1e-6
    per_bucket, _ = quality.train([(ids, share)], np.array([label]), s)
    # AdaGrad's first step has the gradient's direction and length rate * sqrt(dim), in each bucket that the text has
    size = np.linalg.norm(numeric[ids], axis=1, keepdims=True)
    after = vectors.copy()
    after[ids] -= s.rate * np.sqrt(s.dim) * numeric[ids] / size
    z = out @ (share @ vectors[ids]) + np.log([1 - 0.99, 0.99])
    p = np.exp(z - z.max())
    p = p / p.sum() - np.eye(2)[label]
    new_out = out - s.rate * np.outer(p, share @ vectors[ids])
    assert np.allclose(per_bucket, after @ (new_out[1] - new_out[0]), atol=2e-4)


def test_other_kinds():
    text = 'iban GB82 WEST 1234 5698 7654 32 and token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", not internationalisation12'
    found = {(k, text[s:e]): v for k, s, e, v, _ in pii.candidates(text) if k in pii.ALL[4:]}
    assert {k for k in found} == {("iban", "GB82 WEST 1234 5698 7654 32"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")}
    assert all(v[1] == 1 and v[3] == 1 for v in found.values())
