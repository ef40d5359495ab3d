"""Removing lines of repeated three-line windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def line_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of every line, in order; an empty text has one empty line."""
    breaks = np.flatnonzero(raw == 10)
    docs = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.ones(len(docs), bool)
    last[:-1] = docs[1:] != docs[:-1]
    ends[last] = offsets[1:][docs[last]]
    return docs, starts, ends


def _windows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches):
            raw, offsets = common.byte_view(b, "t")
            docs, starts, ends = line_bounds(raw, offsets)
            first = np.flatnonzero(docs[n - 1 :] == docs[: max(len(docs) - n + 1, 0)]) if len(docs) >= n else np.zeros(0, np.int64)
            at = np.searchsorted(docs, docs[first])
            view = memoryview(np.ascontiguousarray(raw))
            digest = b"".join([xxhash.xxh3_128_digest(view[i:j]) for i, j in zip(starts[first].tolist(), ends[first + n - 1].tolist(), strict=True)])
            h = np.frombuffer(digest, np.int64).reshape(-1, 2)
            row = pa.array(docs[first])
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), b.column(0).take(row), b.column(1).take(row), pa.array((first - at).astype(np.int32))], ["h1", "h2", "i", "k", "p"])

    return run


def _cutter(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines = [] if t is None else t.split("\n")
                gone = np.zeros(len(lines) + 1, np.int64)
                for p in found or ():
                    gone[p] += 1
                    gone[p + n] -= 1
                keep = np.cumsum(gone)[: len(lines)] == 0
                kept = t if keep.all() else "\n".join([x for x, k in zip(lines, keep, strict=True) if k])
                rows.append((kept, len(lines), int(len(lines) - keep.sum())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64()), b.column(3)], ["i", "t", "n_lines", "n_removed", "rest"])

    return run


def dedup_lines(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with cut texts, and n_lines and n_removed: no lines of repeated windows but the first.

    Every `window` consecutive lines of a document are hashed (128 bits); the
    first occurrence of a window, by id and then position, stays; the lines
    that any later occurrence covers go, whether in the same or another
    document. A window that stands in very many documents is reduced to its
    first occurrence before the shuffle (a grouped minimum), and the join that
    finds the others splits on skew.

    A text of fewer lines than the window is left as it is; an empty text has
    one line; a null text has none and stays null. Null ids come first in the
    order. Rows that agree in id and text count as one document, so they are
    kept or cut alike. An empty table gives an empty result; other columns go
    through as they are; a table that has n_lines or n_removed already is refused.
    """
    common.without_clash(docs, "n_lines", "n_removed")
    common.prepare(docs.sparkSession)
    source = docs.select(common.ids(docs, id_col).alias("i"), docs[f"`{text_col}`"].alias("t"), common.carried(docs, id_col, text_col))
    source = source.select("i", F.xxhash64("i", "t").alias("k"), "t", "rest")
    found = common.stored(source.select("i", "k", "t").mapInArrow(_windows(window), "h1 long, h2 long, i long, k long, p int"), "windows")
    place = F.struct("i", "k", "p")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first")
    later = found.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("i", "k", "p")
    spots = common.stored(later.groupBy("i", "k").agg(F.collect_set("p").alias("found")), "repeats")
    # the same plan at every size: texts are dealt by id, whatever the number of repeats
    spots = spots.select(F.col("i").alias("si"), F.col("k").alias("sk"), "found").hint("merge")
    joined = source.join(spots, (F.col("k") == F.col("sk")) & F.col("i").eqNullSafe(F.col("si")), "left").select("i", "t", "found", "rest")
    out = joined.mapInArrow(_cutter(window), f"i long, t string, n_lines long, n_removed long, rest {common.sql_type(joined, 'rest')}")
    return common.restored(out, docs, id_col, text_col, "n_lines", "n_removed")


def brute_force(rows: list[tuple[int, str | None]], window: int = 3) -> list[tuple[int, str | None, int, int]]:
    """The same by plain loops, for tests."""
    first: dict[tuple, tuple] = {}
    ordered = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: r[0])
    for i, t in ordered:
        lines = t.split("\n")
        for p in range(len(lines) - window + 1):
            first.setdefault(tuple(lines[p : p + window]), (i, t, p))
    out = []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        gone = {q for p in range(len(lines) - window + 1) if first[tuple(lines[p : p + window])] != (i, t, p) for q in range(p, p + window)}
        out.append((i, None if t is None else "\n".join(x for q, x in enumerate(lines) if q not in gone), len(lines), len(gone)))
    return out
