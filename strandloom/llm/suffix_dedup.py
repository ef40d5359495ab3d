"""Removing repeated strings of bytes by a distributed merge sort of suffixes.

Sorting every suffix of a corpus is not needed to find strings of `span` bytes that
occur twice. Each window of `span` bytes contains an anchor, the k-gram with the
smallest hash in it, which depends on the window's content alone; so equal windows have
equal anchors at equal offsets, and only suffixes that start at anchors are sorted
(about two in span - k). Anchors whose k-gram occurs once in the corpus start nothing
that repeats and are left out before any text is moved.

Each task sorts its suffixes, keeps the length of the prefix that each shares with the
one before (its LCP), and sends every range of the order a front-coded run: LCPs and
what follows them. A range merges its runs with a loser tree in which every loser keeps
its LCP with the winner that beat it: of two candidates the one with the longer LCP is
the smaller without a comparison, and equal LCPs are compared only from there on. In
the merged order, suffixes that share at least k bytes stand together. A window that
begins o bytes before an anchor repeats if another suffix shares the first span - o
bytes (a run of LCPs that long) and the o bytes to the left (compared by hash).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import BASE

GRAM = 32
#: Repeated k-grams sent to the executors as a broadcast, at most; more are joined by a shuffle.
MOST_GRAMS = 1 << 22
#: A k-gram with more different contexts than this is counted window by window instead of in one group.
MOST_CONTEXTS = 100_000
BLOCK = 3 << 20
#: Bytes of suffixes and what stands before them in a range of the order, on average.
RANGE_BYTES = 16 << 20
#: Suffixes that come to the driver to divide the order, at most.
MOST_SAMPLES = 1 << 18
_INVERSE = pow(BASE, -1, 2**64)


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at every position where there are that many."""
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * common.powers(BASE, len(raw)), out=total[1:])
    return common.mix64((total[k:] - total[:-k]) * common.powers(_INVERSE, n))


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best over every w in a row, by doubling."""
    done = 1
    while done * 2 <= w:
        x = best(x[: len(x) - done], x[done:])
        done *= 2
    return x if done == w else best(x[: len(x) - (w - done)], x[w - done :])


def anchors(raw: np.ndarray, offsets: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows within the texts, and their hashes."""
    n, w = len(raw), span - k + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < span:
        return none
    h = gram_hashes(raw, k)
    low = _sliding(h, w, np.minimum)  # of the window that starts here
    for back in range(1, span):
        cut = offsets[1:-1] - back
        low[cut[(cut >= 0) & (cut < len(low))]] = 0
    # a gram is an anchor if it is the smallest of some window that holds it
    edge = np.zeros(w - 1, np.uint64)
    high = _sliding(np.concatenate([edge, low, edge]), w, np.maximum)
    at = np.flatnonzero((high == h) & (h > 0))
    return at, h[at]


def _count_grams(span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.minimum(counts, 2))], ["gram", "n"])

        for b in common.blocks(batches, BLOCK):
            held.append(anchors(*common.byte_view(b, "t"), span, k)[1])
            size += len(held[-1])
            if size >= 2_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _contexts(span: int, k: int, shared):
    """Repeated anchors with a hash of their context; the context itself once per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, BLOCK):
            raw, offsets = common.byte_view(b, "t")
            at, h = anchors(raw, offsets, span, k)
            if shared is None:
                row = np.searchsorted(offsets, at, "right") - 1
                chosen = [np.array(x or (), np.int64) for x in b.column(b.schema.get_field_index("spots")).to_pylist()]
                wanted = np.concatenate([offsets[r] + x for r, x in enumerate(chosen)]) if chosen else np.zeros(0, np.int64)
                keep = np.isin(at, wanted)
            else:
                grams = shared.value
                keep = grams[np.minimum(np.searchsorted(grams, h), len(grams) - 1)] == h if len(grams) else np.zeros(len(h), bool)
            at, h = at[keep], h[keep]
            row = np.searchsorted(offsets, at, "right") - 1
            left = np.minimum(at - offsets[row], span - k)
            right = np.minimum(offsets[row + 1] - at, span)
            data, seen, digests, texts = raw.tobytes(), set(), [], []
            for a, x, y in zip(at.tolist(), left.tolist(), right.tolist(), strict=True):
                text = data[a - x : a + y]
                d = xxhash.xxh3_128_digest(text + x.to_bytes(2, "little"))
                digests.append(d)
                texts.append(None if d in seen else text)
                seen.add(d)
            z = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            size = np.where([t is None for t in texts], 0, left + right).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array((at - offsets[row]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(z[:, 0]), pa.array(z[:, 1]), pa.array(left.astype(np.int32)), pa.array(texts, pa.binary()), pa.array(size)], ["i", "k", "p", "gram", "z1", "z2", "nl", "text", "size"])

    return run


# --- sorted runs, front coding, loser tree -------------------------------------------------------


def lcp(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, given that the first `start` bytes are equal."""
    n = min(len(a), len(b))
    while start < n:
        step = min(32, n - start)
        x, y = a[start : start + step], b[start : start + step]
        if x != y:
            d = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return start + step - (d.bit_length() + 7) // 8
        start += step
    return n


def front_code(run: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run of (suffix, payload): LCP with the one before, what follows it, payload."""
    out, last = [], b""
    for s, payload in run:
        h = lcp(last, s)
        out.append(h.to_bytes(2, "little") + (len(s) - h).to_bytes(2, "little") + len(payload).to_bytes(2, "little") + s[h:] + payload)
        last = s
    return b"".join(out)


def decoded(data: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    """(suffix, LCP with the one before, payload) of a front-coded run."""
    at, last = 0, b""
    while at < len(data):
        h, n, m = (int.from_bytes(data[at + j : at + j + 2], "little") for j in (0, 2, 4))
        at += 6
        last = last[:h] + data[at : at + n]
        yield last, h, data[at + n : at + n + m]
        at += n + m


def merge(runs: list[Iterator[tuple[bytes, int, bytes]]]) -> Iterator[tuple[bytes, int, bytes]]:
    """Merge sorted runs with their LCPs into one, with its LCPs, by a loser tree.

    A node holds the loser of its match and the loser's LCP with the winner. When the
    winner is replaced by the next of its run, whose LCP with it is known, every match on
    the way up is between two LCPs with the same string: the longer one wins, and only
    equal ones are compared, from there on.
    """
    size = 1
    while size < max(len(runs), 1):
        size *= 2
    heads: list[tuple[bytes, int, bytes] | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    loser, shared = [0] * size, [0] * size

    def play(a: int, ha: int, b: int, hb: int) -> tuple[int, int, int, int]:
        """Winner and its LCP with the last winner, loser and its LCP with this winner."""
        if heads[b] is None:
            return a, ha, b, 0
        if heads[a] is None:
            return b, hb, a, 0
        if ha > hb:
            return a, ha, b, hb
        if hb > ha:
            return b, hb, a, ha
        x, y = heads[a][0], heads[b][0]
        h = lcp(x, y, ha)
        if x[h : h + 1] <= y[h : h + 1]:
            return a, ha, b, h
        return b, hb, a, h

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, 0
        (a, ha), (b, hb) = build(2 * node), build(2 * node + 1)
        win, hw, loser[node], shared[node] = play(a, ha, b, hb)
        return win, hw

    win, h = build(1)
    while heads[win] is not None:
        s, _, payload = heads[win]
        yield s, h, payload
        heads[win] = following = next(runs[win], None)
        h, node = (following[1] if following else 0), (win + size) // 2
        while node:
            win, h, loser[node], shared[node] = play(win, h, loser[node], shared[node])
            node //= 2


def _make_runs(splitters: list[bytes], k: int):
    """Sort a task's suffixes, up to a bounded number at once, and send each range a front-coded run."""

    def send(held: list[tuple[bytes, bytes]]):
        held.sort()
        parts: dict[int, list] = {}
        for s, payload in held:
            parts.setdefault(bisect_right(splitters, s[:k]), []).append((s, payload))
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([front_code(r) for r in parts.values()], pa.binary())], ["part", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        for b in batches:
            for z1, z2, n, x, t in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True):
                payload = z1.to_bytes(8, "little", signed=True) + z2.to_bytes(8, "little", signed=True) + n.to_bytes(1, "little") + t[:x][::-1]
                held.append((t[x:], payload))
            if len(held) >= 100_000:
                yield send(held)
                held = []
        if held:
            yield send(held)

    return run


def _merge_runs(span: int, k: int):
    schema = ["z1", "z2", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [x for b in batches for x in b.column(1).to_pylist()]
        group: list[tuple[bytes, int, bytes]] = []
        for s, h, payload in merge([decoded(r) for r in runs]):
            if h < k and len(group) >= 20_000:
                yield pa.RecordBatch.from_arrays(resolve(group, span, k), schema)
                group = []
            group.append((s, h, payload))
        if group:
            yield pa.RecordBatch.from_arrays(resolve(group, span, k), schema)

    return run


def resolve(group: list[tuple[bytes, int, bytes]], span: int, k: int) -> list[pa.Array]:
    """Smallest and largest offset of a repeated window before each anchor that has one."""
    n, widest = len(group), span - k
    near = np.array([h for _, h, _ in group])
    right = np.array([len(s) for s, _, _ in group])
    z = np.frombuffer(b"".join([p[:16] for _, _, p in group]), np.int64).reshape(-1, 2)
    many = np.array([p[16] for _, _, p in group])
    left = np.array([len(p) - 17 for _, _, p in group])
    before = np.frombuffer(b"".join([p[17:].ljust(widest, b"\0") for _, _, p in group]), np.uint8).reshape(n, widest)
    low, high = np.full(n, span), np.full(n, -1)
    # the same context in several places repeats as a whole
    _, same = np.unique(z, axis=0, return_inverse=True)
    twice = np.bincount(same.ravel(), many)[same.ravel()] >= 2
    first, last = np.maximum(0, span - right), np.minimum(widest, left)
    whole = twice & (first <= last)
    low[whole], high[whole] = first[whole], last[whole]
    h = np.zeros(n, np.uint64)
    for o in range(widest + 1):
        if o:
            h = common.mix64(h * np.uint64(BASE) + before[:, o - 1].astype(np.uint64) + np.uint64(1))
        at = np.flatnonzero((o <= last) & (o >= first))
        if len(at) < 2:
            continue
        block = np.cumsum(near < span - o)[at].astype(np.uint64)
        _, key, counts = np.unique(h[at] ^ common.mix64(block), return_inverse=True, return_counts=True)
        hit = at[counts[key] >= 2]
        low[hit] = np.minimum(low[hit], o)
        high[hit] = np.maximum(high[hit], o)
    found = np.flatnonzero(high >= 0)
    return [pa.array(z[found, 0]), pa.array(z[found, 1]), pa.array(low[found].astype(np.int32)), pa.array(high[found].astype(np.int32))]


def _explode_windows(span: int, k: int):
    """Every window of a context, by hash; for k-grams with very many contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for z1, z2, n, x, t in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True):
                for o in range(max(0, span - (len(t) - x)), min(span - k, x) + 1):
                    out.append((z1, z2, n, o, xxhash.xxh3_128_digest(t[x - o : x - o + span] + o.to_bytes(2, "little"))))
            h = np.frombuffer(b"".join([r[4] for r in out]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["z1", "z2", "n", "o", "w1", "w2"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int32())
    for b in batches:
        spans, kept, sizes = [], [], []
        for t, starts, ends in zip(*(b.column(j).to_pylist() for j in (1, 2, 3)), strict=True):
            data = (t or "").encode()
            merged: list[list[int]] = []
            for s, e in sorted(zip(starts or (), ends or (), strict=True)):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            edges = [0, *(x for m in merged for x in m), len(data)]
            kept.append(b"".join([data[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2)]))
            spans.append([x for m in merged for x in m])
            sizes.append(len(data))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], ["i", "kept", "n_bytes", "spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, span: int = 200, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept, n_bytes, spans, kept_sha256): texts without bytes of strings that start elsewhere too.

    `kept` is binary, as cutting may split a character; `spans` are starts and ends of
    the removed runs, in bytes. All copies go, the first included; strings are judged
    on the input. Null and empty texts, and those shorter than span, have no windows
    and stay; repeated rows are places of their own (each repeats the other); null ids
    are documents too; an empty table gives no rows; other columns are not read.

    k-grams that repeat are broadcast only if they are few enough, and joined
    otherwise; a k-gram with very many contexts is counted window by window
    with grouped sums, so no group is ever held whole beyond MOST_CONTEXTS.
    """
    spark = common.prepare(docs.sparkSession)
    source = docs.select(common.ids(docs, id_col).alias("i"), docs[f"`{text_col}`"].alias("t"))
    source = source.select("i", F.xxhash64("i", "t").alias("k"), "t")
    grams = source.select("t").mapInArrow(_count_grams(span, gram), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    grams = common.stored(grams, "grams")
    shape = "i long, k long, p int, gram long, z1 long, z2 long, nl int, text binary, size int"
    if grams.count() <= MOST_GRAMS:
        shared = spark.sparkContext.broadcast(np.sort(grams.toArrow()["gram"].to_numpy().view(np.uint64)))
        found = source.mapInArrow(_contexts(span, gram, shared), shape)
    else:
        found = _joined_contexts(source, grams, span, gram, shape)
    found = common.stored(found, "contexts")

    columns = ["z1", "z2", "n", "nl", "text"]
    # one row per context, wherever and however often it stands; n is 2 if in several places
    numbers = found.groupBy("z1", "z2").agg(F.max("gram").alias("gram"))
    crowded = common.stored(numbers.groupBy("gram").count().where(F.col("count") > MOST_CONTEXTS).select("gram"), "crowded")
    texts = found.groupBy("z1", "z2").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("n"), F.max("gram").alias("gram"), F.max("nl").alias("nl"), F.max("text").alias("text"))
    usual = texts.join(F.broadcast(crowded) if crowded.count() <= MOST_GRAMS else crowded, "gram", "left_anti")
    # as many ranges as the suffixes' bytes ask for, one to a task
    parts = 1 + (found.agg(F.sum("size")).first()[0] or 0) // RANGE_BYTES
    wanted = min(max(4096, 32 * parts), MOST_SAMPLES)
    sample = [bytes(r[0]) for r in found.where("size > 0").select(F.expr(f"substring(text, nl + 1, {gram})").alias("s"), "z1").orderBy("z1").limit(wanted).collect()]
    splitters = sorted(set(np.array(sorted(sample), object)[np.linspace(0, len(sample), parts + 1)[1:-1].astype(int)].tolist())) if sample else []
    runs = usual.select(*columns).mapInArrow(_make_runs(splitters, gram), "part int, run binary")
    marks = runs.repartitionById(parts, "part").mapInArrow(_merge_runs(span, gram), "z1 long, z2 long, low int, high int")
    windows = texts.join(crowded, "gram", "left_semi").select(*columns).mapInArrow(_explode_windows(span, gram), "z1 long, z2 long, n int, o int, w1 long, w2 long")
    again = windows.select("z1", "z2", "n", "w1", "w2").distinct().groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2")
    slow = windows.join(again, ["w1", "w2"], "left_semi").select("z1", "z2", F.col("o").alias("low"), F.col("o").alias("high"))
    marks = marks.union(slow) if crowded.limit(1).count() else marks
    marks = common.stored(marks.groupBy("z1", "z2").agg(F.min("low").alias("low"), F.max("high").alias("high")), "marks")

    spots = found.select("i", "k", "p", "z1", "z2").join(marks, ["z1", "z2"]).select("i", "k", (F.col("p") - F.col("high")).alias("s"), (F.col("p") - F.col("low") + span).alias("e"))
    spots = common.stored(spots.groupBy("i", "k").agg(F.collect_list(F.struct("s", "e")).alias("x")).select(F.col("i").alias("si"), F.col("k").alias("sk"), F.col("x.s").alias("s"), F.col("x.e").alias("e")), "spots").hint("merge")
    joined = source.join(spots, (F.col("k") == F.col("sk")) & F.col("i").eqNullSafe(F.col("si")), "left").select("i", "t", "s", "e")
    return joined.mapInArrow(_cut, "i long, kept binary, n_bytes long, spans array<int>, kept_sha256 string").withColumnRenamed("i", id_col)


def _joined_contexts(source: DataFrame, grams: DataFrame, span: int, gram: int, shape: str) -> DataFrame:
    """The same contexts where the repeated k-grams are too many for a broadcast."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, BLOCK):
            raw, offsets = common.byte_view(b, "t")
            at, h = anchors(raw, offsets, span, gram)
            row = np.searchsorted(offsets, at, "right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array((at - offsets[row]).astype(np.int32)), pa.array(h.view(np.int64))], ["i", "k", "p", "gram"])

    hits = source.mapInArrow(places, "i long, k long, p int, gram long").join(grams, "gram").groupBy("i", "k").agg(F.collect_set("p").alias("spots")).select(F.col("i").alias("si"), F.col("k").alias("sk"), "spots")
    both = source.join(hits, (F.col("k") == F.col("sk")) & F.col("i").eqNullSafe(F.col("si"))).select("i", "k", "t", "spots")
    return both.mapInArrow(_contexts(span, gram, None), shape)


def brute_force(texts: list[str | None], span: int = 200) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by plain loops, for tests."""
    data = [(t or "").encode() for t in texts]
    count: dict[bytes, int] = {}
    for d in data:
        for p in range(len(d) - span + 1):
            count[d[p : p + span]] = count.get(d[p : p + span], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d) + 1)
        for p in range(len(d) - span + 1):
            if count[d[p : p + span]] > 1:
                gone[p : p + span] = b"\1" * span
        runs = sum(1 for p in range(len(d)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return out
