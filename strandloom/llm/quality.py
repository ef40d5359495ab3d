"""Quality classifier: averaged hashed word and character n-gram vectors, softmax, numpy SGD.

A text's features are its words, their character n-grams, and one word bigram: a word that
repeats the one before it is the bigram "same", whatever the word. Each has a bucket with a
learned vector; a text is the average of its features' vectors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import BASE

#: At most so many labelled documents train the model; the rest of the labels are not read further.
TRAIN_ROWS = 4000


@dataclass
class Settings:
    bits: int = 17
    dim: int = 16
    least: int = 2
    most: int = 3
    epochs: int = 4
    rate: float = 0.2
    seed: int = 1


def parts(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its character n-grams, and offsets of the words into them.

    A word is taken with a mark at either end; all words are hashed in one go.
    """
    n = len(words)
    size = np.array([len(w) for w in words], np.int64) + 2
    chars = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(size) - size
    owner = np.repeat(np.arange(n), size)
    at = np.arange(len(chars)) - starts[owner]
    p = common.powers(BASE, int(size.max()))
    found, whose = [common.mix64(np.add.reduceat(chars * p[at], starts))], [np.arange(n)]
    for k in range(s.least, s.most + 1):
        ok = np.flatnonzero(at + k <= size[owner])
        h = np.full(len(ok), k << 40, np.uint64)
        for j in range(k):
            h += chars[ok + j] * p[j]
        found.append(common.mix64(h))
        whose.append(owner[ok])
    whose = np.concatenate(whose)
    ids = (np.concatenate(found) >> np.uint64(64 - s.bits)).astype(np.int64)[np.argsort(whose, kind="stable")]
    return ids, np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=n))])


def tokens(text: str) -> Counter:
    """Words of a text and the bigrams of a word and itself, which have one name for all words."""
    words = text.split()
    found = Counter(words)
    same = sum(map(str.__eq__, words, words[1:]))
    if same:
        found["\x00same"] = same
    return found


def bags(texts: list[str], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text and their shares in its average; a word's vector is the mean of its parts."""
    counts = [tokens(t) for t in texts]
    words = sorted({w for c in counts for w in c})
    if not words:
        return [(np.zeros(0, np.int64), np.zeros(0)) for _ in texts]
    row = {w: i for i, w in enumerate(words)}
    ids, ptr = parts(words, s)
    out = []
    for c in counts:
        if not c:
            out.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        mine = np.array([row[w] for w in c])
        weight = np.array(list(c.values()), float)
        size = ptr[mine + 1] - ptr[mine]
        flat = np.repeat(ptr[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        got, at = np.unique(ids[flat], return_inverse=True)
        out.append((got, np.bincount(at, np.repeat(weight / size, size)) / weight.sum()))
    return out


class Scorer:
    """Scores texts by a trained model; remembers words' logits within the worker's bound."""

    def __init__(self, s: Settings, per_bucket: np.ndarray, bias: float) -> None:
        self.s, self.per_bucket, self.bias = s, per_bucket, bias
        self.known = common.Memory(common.MEMORY_BYTES)

    def learn(self, words: set[str]) -> dict[str, float]:
        """Logits of these words."""
        young, old = self.known.young, self.known.old
        found = {w: young[w] for w in words & young.keys()}
        missing, fresh = words - found.keys(), []
        for w in missing:
            if (v := old.get(w)) is None:
                fresh.append(w)
            else:
                found[w] = v
        for i in range(0, len(fresh), 50_000):
            part = fresh[i : i + 50_000]
            ids, ptr = parts(part, self.s)
            found.update(zip(part, (np.add.reduceat(self.per_bucket[ids], ptr[:-1]) / np.diff(ptr)).tolist(), strict=True))
        for w in missing:
            if len(w) <= 64:
                self.known.put(w, found[w], common.text_bytes(w) + 24)
        return found

    def scores(self, texts: list[str]) -> np.ndarray:
        counts = [tokens(t) for t in texts]
        known = self.learn({w for c in counts for w in c})
        logits = [sum([n * known[w] for w, n in c.items()]) / c.total() if c else 0.0 for c in counts]
        return 1 / (1 + np.exp(-(np.array(logits, float) + self.bias)))


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Logit per bucket and bias of label 1 against 0, from stochastic gradient descent.

    A document's vector is the average of its buckets' vectors, both classes
    have an output vector, and the softmax of two classes is the logistic of
    their difference; so a bucket's vector times that difference is all that
    scoring needs. A step goes along the gradient of the loss, whose part for a bucket is
    its share times the gradient at the average; every bucket's rate is divided by the
    root of its squared gradients so far (AdaGrad), as shares are tiny and unequal.
    """
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (1 << s.bits, s.dim)).astype(np.float32)
    out = np.zeros((2, s.dim), np.float32)
    prior = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
    bias = np.log(np.array([1 - prior, prior]))
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    squares = np.full(1 << s.bits, 1e-8)
    total, done = max(1, s.epochs * len(examples)), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(examples)):
            ids, share = examples[i]
            rate = s.rate * (1 - done / total)
            done += 1
            if not len(ids):
                continue
            rows = vectors[ids]
            mean = share @ rows
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= (rate * np.outer(p, mean)).astype(np.float32)
            bias -= rate * 0.1 * p
            squares[ids] += share**2 * (back @ back) / s.dim
            vectors[ids] = rows - ((rate * share / np.sqrt(squares[ids]))[:, None] * back[None, :]).astype(np.float32)
    return (vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0])


def _featurise(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = bags(common.texts(b, "t"), s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.astype("<i4").tobytes() for x, _ in made], pa.binary()), pa.array([w.astype("<f4").tobytes() for _, w in made], pa.binary())], ["i", "y", "ids", "shares"])

    return run


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Train on at most train_rows labelled documents, those with the smallest hashes of their ids.

    Labels of held-out ids (crc32 of the id as text divisible by 5), null labels
    and null ids are not used; an id with several labels takes the smallest.
    Of several documents with one id the smallest text counts. Nothing but the
    text is an input.
    """
    s = settings or Settings()
    common.prepare(docs.sparkSession)
    marks = labels.select(common.ids(labels, id_col).alias("i"), labels[f"`{label_col}`"].cast("int").alias("y")).dropna()
    marks = marks.where(~held_out("i")).groupBy("i").agg(F.min("y").alias("y"))
    chosen = marks.orderBy(F.xxhash64(F.lit(17), "i"), "i").limit(train_rows)
    source = docs.select(common.ids(docs, id_col).alias("i"), docs[f"`{text_col}`"].alias("t"))
    # bounded by train_rows, whatever the size of the tables
    rows = source.join(F.broadcast(chosen), "i").select("i", "t", "y").mapInArrow(_featurise(s), "i long, y int, ids binary, shares binary").toArrow()
    rows = rows.sort_by([("i", "ascending"), ("ids", "ascending")])
    examples = [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(w, "<f4").astype(np.float64)) for a, w in zip(rows["ids"].to_pylist(), rows["shares"].to_pylist(), strict=True)]
    return train(examples, rows["y"].to_numpy().astype(int), s)


def score(docs: DataFrame, model: tuple[np.ndarray, float], settings: Settings | None = None, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with score (of label 1) and predicted (1 if the score reaches cut, else 0).

    An empty or null text gets the score of the bias alone. Rows are scored one by one,
    so repeated rows get equal scores; an empty table gives no rows. Other columns go
    through as they are; a table that has score or predicted already is refused.
    """
    common.without_clash(docs, "score", "predicted")
    s = settings or Settings()
    spark = common.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((s, *model))
    key = xxhash.xxh3_64_hexdigest(model[0].tobytes()) + str(model[1]) + str(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = common.worker_keeps(("quality", key), lambda: Scorer(*shared.value))
        for b in batches:
            got = scorer.scores(common.texts(b, "t"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got), pa.array((got >= cut).astype(np.int32))], ["i", "t", "rest", "score", "predicted"])

    source = docs.select(common.ids(docs, id_col).alias("i"), docs[f"`{text_col}`"].alias("t"), common.carried(docs, id_col, text_col))
    out = source.mapInArrow(run, f"i long, t string, rest {common.sql_type(source, 'rest')}, score double, predicted int")
    return common.restored(out, docs, id_col, text_col, "score", "predicted")
