"""Token counts from pre-token frequencies, without materialising ids.

1. Every distinct pre-token of the corpus is a row of one table, with its number of
   occurrences; its pieces are counted there, once.
2. The most frequent pre-tokens, a bounded number, are sent to the executors. The rest
   of each document's pre-token frequencies are rows (document, pre-token, frequency),
   joined to the table and summed. No pre-token of that join is hot: one that is not
   among the FREQUENT stands for less than 1 / FREQUENT of all occurrences.

The units are runs of whole pre-tokens between single spaces, with a final full stop or
comma taken off words of Latin letters; see pretokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .pretokens import cut, library

#: Pre-tokens sent to the executors with their numbers of pieces.
FREQUENT = 1 << 18
#: Distinct pre-tokens that a task counts before it sends them on.
HELD = 1 << 18
#: Latin letters, then a full stop or a comma: two pre-tokens in any version of Unicode.
_ENDED = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+[.,]")


def stem(unit: str) -> tuple[str, str]:
    """A unit without its final mark, and the mark."""
    return (unit[:-1], unit[-1]) if unit[-1:] in ".," and _ENDED.fullmatch(unit) else (unit, "")


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pre-tokens with their occurrences; a space or ^ before each says how it stands in its text."""
    held: Counter = Counter()
    firsts: Counter = Counter()

    def flush():
        found: Counter = Counter()
        for unit, n in held.items():
            found[" " + stem(unit)[0]] += n
        for unit, n in firsts.items():
            found["^" + unit] += n
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["w", "n"])

    for b in batches:
        for t in common.texts(b, "t"):
            units = cut(t)
            firsts[units.pop(0)] += 1
            held.update(units)
        if len(held) + len(firsts) >= HELD:
            yield flush()
            held.clear()
            firsts.clear()
    if held or firsts:
        yield flush()


def _pieces(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = common.worker_keeps(("library", tokenizer), lambda: library(tokenizer))
        for b in batches:
            units = [w if w[0] == " " else w[1:] for w in b.column(0).to_pylist()]
            for i in range(0, len(units), 2000):
                part = b.slice(i, 2000)
                counts = [len(e) for e in tok.encode_batch_fast(units[i : i + 2000], add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64())], ["w", "n", "pieces"])

    return run


def _frequencies(shared):
    """Per document: what its frequent pre-tokens sum to, and the frequencies of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        known = shared.value
        marks = {m: known[m] for m in ",."}
        for b in batches:
            sums, words, times, ends = [], [], [], [0]
            for t in common.texts(b, "t"):
                units = cut(t)
                total, first = 0, units.pop(0)  # the first unit has no space before it
                for unit, n in Counter(units).items():
                    v = known.get(" " + unit)
                    if v is None:
                        word, mark = stem(unit)
                        if mark:
                            total += n * marks[mark]
                            v = known.get(" " + word)
                        if v is None:
                            words.append(" " + word)
                            times.append(n)
                            continue
                    total += n * v
                v = known.get("^" + first)
                if v is None:
                    words.append("^" + first)
                    times.append(1)
                else:
                    total += v
                sums.append(total)
                ends.append(len(words))
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b.num_rows)), b.column(0), size, pa.array(sums, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(words, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))], ["u", "i", "n_bytes", "n", "words", "times"])
            row += b.num_rows

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): bytes and tokens of every text.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null;
    repeated rows give repeated rows; an empty table gives an empty result;
    other columns are not read. special strings inside a text are matched as the
    tokenizer does by default. A very long text without spaces is one unit.
    """
    spark = common.prepare(docs.sparkSession)
    source = docs.select(common.ids(docs, id_col).alias("i"), docs[f"`{text_col}`"].alias("t"))
    seen = source.select("t").mapInArrow(_distinct, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    pieces = common.stored(seen.mapInArrow(_pieces(tokenizer), "w string, n long, pieces long"), "pretokens")
    frequent = pieces.where(F.length("w") <= 64).orderBy(F.desc("n"), "w").limit(FREQUENT).select("w", "pieces").toArrow()
    known = dict(zip(frequent["w"].to_pylist(), frequent["pieces"].to_pylist(), strict=True))
    tok = library(tokenizer)
    known |= {m: len(tok.encode(m, add_special_tokens=False)) for m in ",."}
    shared = spark.sparkContext.broadcast(known)
    shape = "u long, i long, n_bytes long, n long, words array<string>, times array<long>"
    counted = common.stored(source.mapInArrow(_frequencies(shared), shape), "frequencies")
    rest = counted.select("u", F.explode(F.arrays_zip("words", "times")).alias("x")).select("u", F.col("x.words").alias("w"), "x.times")
    more = rest.join(pieces.select("w", "pieces"), "w").groupBy("u").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    n = F.col("n") + F.coalesce("more", F.lit(0))
    out = counted.select("u", "i", "n_bytes", "n").join(more, "u", "left").select("i", "n_bytes", n.alias("n_tokens"))
    return out.select(F.col("i").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
