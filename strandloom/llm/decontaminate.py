"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import grams, letters_and_digits, word_hashes

#: Words of benchmark texts whose index is sent to the executors at once; more are done in turns.
BLOCK_WORDS = 2_000_000
SECOND = 0xA24BAED4963EE407


def winnow(g: np.ndarray, bounds: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the fingerprints: the last smallest k-gram of every w in a row within one text."""
    n = int(bounds[-1])
    chosen = np.zeros(n, bool)
    span = k + w - 1
    if n < span:
        return np.flatnonzero(chosen)
    m = n - span + 1
    best, arg = g[:m].copy(), np.arange(m)
    for j in range(1, w):
        x = g[j : j + m]
        less = x <= best
        np.copyto(best, x, where=less)
        arg[less] = np.flatnonzero(less) + j
    valid = within(bounds, span, m)
    chosen[arg[valid]] = True
    return np.flatnonzero(chosen)


def within(bounds: np.ndarray, span: int, m: int) -> np.ndarray:
    """Which of the first m words begin `span` words of one text."""
    valid = np.ones(m, bool)
    for back in range(1, span):
        cut = bounds[1:-1] - back
        valid[cut[(cut >= 0) & (cut < m)]] = False
    return valid


@dataclass
class Index:
    """Windows of some benchmark items, by number of words, and their fingerprints."""

    span: int
    k: int
    prints: np.ndarray  # sorted
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # words: first hash (sorted), second, CSR of items


def build(ids: list[int], texts: list[str], span: int, k: int) -> Index:
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    words, bounds = word_hashes(raw, offsets, letters_and_digits())
    size = np.diff(bounds)
    w = span - k + 1
    g = grams(words, k)
    prints = np.unique(g[winnow(g, bounds, k, w)]) if len(g) else np.zeros(0, np.uint64)
    windows = {}
    for n in sorted({min(int(s), span) for s in size if s}):
        h1, h2 = grams(words, n), grams(words, n, SECOND)
        start = np.concatenate([np.arange(a, b - n + 1) for a, b, s in zip(bounds[:-1], bounds[1:], size, strict=True) if s == n or (n == span and s >= span)]).astype(np.int64)
        item = np.array(ids, np.int64)[np.searchsorted(bounds, start, "right") - 1]
        order = np.lexsort((item, h2[start], h1[start]))
        a, b, item = h1[start][order], h2[start][order], item[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        heads = np.flatnonzero(new)
        windows[n] = (a[heads], b[heads], np.append(heads, len(a)), item)
    return Index(span, k, prints, windows)


def look(words: np.ndarray, bounds: np.ndarray, x: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word whether it is hit; pairs (text, item) that have an occurring window."""
    hit = np.zeros(len(words) + 1, np.int64)
    docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n, (h1, h2, ptr, item) in x.windows.items():
        m = len(words) - n + 1
        if m <= 0:
            continue
        if n == x.span:
            g = grams(words, x.k)
            spots = winnow(g, bounds, x.k, n - x.k + 1)
            spots = spots[_member(g[spots], x.prints)]
            # a shared window holds a shared fingerprint; try every window that holds this one
            start = (spots[:, None] - np.arange(n - x.k + 1)[None, :]).ravel()
            start = np.unique(start[(start >= 0) & (start < m)])
        else:
            start = np.flatnonzero(_member(grams(words, n), h1))
        start = start[within(bounds, n, m)[start]]
        if not len(start):
            continue
        near = words[start[:, None] + np.arange(n)[None, :]]
        a = common.mix64((near * common.powers(0xD6E8FEB86659FD93, n)).sum(1, dtype=np.uint64))
        b = common.mix64((near * common.powers(SECOND, n)).sum(1, dtype=np.uint64))
        at = np.minimum(np.searchsorted(h1, a), len(h1) - 1)
        same = (h1[at] == a) & (h2[at] == b)
        start, at = start[same], at[same]
        np.add.at(hit, start, 1)
        np.add.at(hit, start + n, -1)
        doc = np.searchsorted(bounds, start, "right") - 1
        pair = np.unique(np.stack([doc, at]), axis=1)
        count = (ptr[1:] - ptr[:-1])[pair[1]]
        flat = np.repeat(ptr[pair[1]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        docs.append(np.repeat(pair[0], count))
        items.append(item[flat])
    pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1)
    return np.cumsum(hit)[:-1] > 0, pairs[0], pairs[1]


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _runs(mask: np.ndarray) -> np.ndarray:
    """Starts and ends, in turn, of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.astype(np.int32)


def _pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters_and_digits()
        for b in common.blocks(batches):
            raw, offsets = common.byte_view(b, "t")
            words, bounds = word_hashes(raw, offsets, table)
            hit, doc, item = look(words, bounds, shared.value)
            for r, s in enumerate(b.column(2).to_pylist()):
                for i, j in zip(s[::2], s[1::2], strict=True):
                    hit[bounds[r] + i : bounds[r] + j] = True
            for_doc = np.searchsorted(doc, np.arange(b.num_rows + 1))
            spans, items = [], []
            touched = np.zeros(b.num_rows, bool)
            touched[np.searchsorted(bounds, np.flatnonzero(hit), "right") - 1] = True
            for r, old in enumerate(b.column(3).to_pylist()):
                spans.append(_runs(hit[bounds[r] : bounds[r + 1]]) if touched[r] else [])
                items.append(sorted({*old, *item[for_doc[r] : for_doc[r + 1]].tolist()}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64())), pa.array(np.diff(bounds)), b.column(4)], ["i", "t", "spans", "items", "n_words", "rest"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 4, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with n_words, n_hit, spans and items: which words stand in windows of benchmark items.

    Fingerprints are k-gram hashes, the smallest of every span - k + 1 in a row,
    so any shared run of `span` words shares one. Documents' fingerprints are
    looked up among the benchmark's, and each hit is extended to the windows
    around it, which are compared by two 64-bit hashes. Items of fewer words
    are one window each, and there every gram of that length is a fingerprint.
    `spans` are starts and ends of hit runs, in words; `items` are the ids of
    items with an occurring window.

    The benchmark's index is sent to the executors only in blocks of at most
    BLOCK_WORDS words (or one longer item); a larger benchmark takes several
    turns over the documents within the same stage. Documents are never
    shuffled, so neither a common passage nor a long text makes a hot task.

    Null and empty texts have no words; a null item id or text is no item;
    items with equal ids are one item; repeated documents are judged one by
    one; empty tables give no hits or no rows. Other columns go through as they are;
    a table that has one of the four that are added already is refused.
    """
    common.without_clash(docs, "n_words", "n_hit", "spans", "items")
    spark = common.prepare(docs.sparkSession)
    out = docs.select(common.ids(docs, id_col).alias("i"), docs[f"`{text_col}`"].alias("t"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<bigint>").alias("items"), common.carried(docs, id_col, text_col))
    kind = common.sql_type(out, "rest")
    for ids, texts in _item_blocks(benchmark.select(common.ids(benchmark, item_col).alias("i"), benchmark[f"`{item_text_col}`"].alias("t")).dropna()):
        shared = spark.sparkContext.broadcast(build(ids, texts, span, k))
        out = out.select("i", "t", "spans", "items", "rest").mapInArrow(_pass(shared), f"i long, t string, spans array<int>, items array<long>, n_words long, rest {kind}")
    lengths = F.aggregate(F.transform("spans", lambda x, j: F.when(j % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return common.restored(out.withColumn("n_hit", lengths), docs, id_col, text_col, "n_words", "n_hit", "spans", "items")


def _item_blocks(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """At least one block, so that words are counted even without a benchmark."""
    ids, texts, n, any_yet = [], [], 0, False
    for r in items.toLocalIterator():
        size = len(r["t"]) // 2 + 1
        if ids and n + size > BLOCK_WORDS:
            yield ids, texts
            ids, texts, n, any_yet = [], [], 0, True
        ids.append(r["i"])
        texts.append(r["t"])
        n += size
    if ids or not any_yet:
        yield ids, texts


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int | None, str | None]], span: int = 10) -> list[tuple[int, int, int, list[int]]]:
    """(id, n_words, n_hit, items) by plain loops, for tests."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(t):
        return pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    windows: dict[tuple, set] = {}
    for i, t in items:
        if i is not None and t is not None and (w := words(t)):
            n = min(len(w), span)
            for p in range(len(w) - n + 1):
                windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if x := windows.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= x
        out.append((i, len(w), len(hit), sorted(found)))
    return out
