"""N-gram Jaccard join with a token-group matrix.

A document is the set of its distinct word n-grams, hashed to 64 bits. Equal
sets are one class. Classes whose similarity reaches the threshold are linked:

1. Tokens have one global order, by the exact number of classes that hold them (in 255
   steps), rarest first, then by hash. The numbers come from an exchange between blocks
   of documents and ranges of tokens: a block sends its distinct tokens to their ranges,
   a range counts them over all blocks and sends the numbers back. Both are sized by the
   corpus, so the plan is the same at every size.
2. Two sets that reach the threshold share a token among the first few of each in this
   order (prefix filter), so only those are indexed, and of them only the ones that a
   second class holds too.
3. Every indexed token has a pivot, its smallest class. Each class is compared
   with the pivots of its tokens, which is linear in the index, and what is
   linked so makes groups of similar documents.
4. The token-group matrix says which groups hold an indexed token. A query class
   looks its tokens up there, and gets the groups that it isn't in yet. Each group
   stores the union of its members' tokens, in pieces of bounded size; how many of the
   query's tokens are in the union bounds the overlap with every member. Only groups
   whose bound reaches the needed overlap are opened, and of their members only those
   that share a token with the query early enough in the order are compared.

Pairs within a group are never compared, as they are connected already.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .words import grams, not_white, word_hashes

CELLS = 128
#: Tokens of a block of documents, and of a range of tokens, on average.
BLOCK_TOKENS, RANGE_TOKENS = 1 << 19, 1 << 20
#: Tokens in a piece of a group's union, on average.
UNION_TOKENS = 4096
#: Tasks that share the tokens of one group until its pieces are known.
SALTS = 32


def token_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of every text; a shorter text is one gram of its own."""
    words, bounds = word_hashes(raw, offsets, not_white())
    g = grams(words, n)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            out.append(grams(words[a:b], b - a, 0xB5297A4D3F84D5B5 + 2 * (b - a)))
        else:
            out.append(g[:0])
    return out


def prefix_lengths(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many first tokens a set looks up, and how many it is found by, if the other set is no smaller."""
    look = n - -(-n * percent // 100) + 1
    index = n - -(-n * 2 * percent // (100 + percent)) + 1
    return look, index


def smallest_size(percent: int) -> int:
    """Sets below this size link with equal sets only."""
    n = 1
    while n * 100 < percent * (n + 1):
        n += 1
    return n


def _described(n: int):
    """Size and 128-bit hash of every document's set, and the first document of its block with that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches):
            sets = token_sets(*common.byte_view(b, "t"), n)
            size = np.array([len(s) for s in sets], np.int64)
            every = np.concatenate([*sets, np.zeros(0, np.uint64)])
            doc = np.repeat(np.arange(len(sets)), size)
            h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            np.add.at(h1, doc, common.mix64(every + np.uint64(11)))
            np.add.at(h2, doc, common.mix64(every ^ np.uint64(0x5851F42D4C957F2D)))
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False) & (size > 0)
            i, k = b.column(0).fill_null(0).to_numpy(), b.column(1).to_numpy()
            order = np.lexsort((k, i, h2, h1, size, ~known))
            first, last = np.arange(len(order)), None
            for at, row in enumerate(order.tolist()):
                if last is not None and known[row] and size[row] == size[last] and h1[row] == h1[last] and h2[row] == h2[last]:
                    first[row] = last
                else:
                    last = row
            none = pa.array(~known)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(i[first], mask=~known), pa.array(k[first], mask=~known)], ["i", "k", "n", "h1", "h2", "li", "lk"])

    return run


# --- the exchange that counts tokens ---------------------------------------------------------------


def _wanted(left: pa.Table, right: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """i and k of a block's classes, the sizes of their sets and the tokens in a row."""
    i, k = left["i"].to_numpy(), left["k"].to_numpy()
    reps = set(zip(right["i"].to_pylist(), right["k"].to_pylist(), strict=True))
    rows = []
    for row, key in enumerate(zip(i.tolist(), k.tolist(), strict=True)):
        if key in reps:
            reps.discard(key)  # repeated rows count once
            rows.append(row)
    rows = np.array(rows, np.int64)
    sets: list[np.ndarray] = []
    chosen = left.select(["t"]).take(pa.array(rows))
    for b in common.blocks(chosen.to_batches()):
        sets += token_sets(*common.byte_view(b, "t"), n)
    return i[rows], k[rows], np.array([len(s) for s in sets], np.int64), np.concatenate([*sets, np.zeros(0, np.uint64)])


def _bounds(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2 ** bits ranges begins in sorted tokens."""
    if not bits:
        return np.array([0, len(tokens)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])


def _ask(n: int, bits: int):
    """A block's distinct tokens to their ranges: 32 more bits of each, and how many classes hold it."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        _, _, _, every = _wanted(left, right, n)
        tokens, counts = np.unique(every, return_counts=True)
        bounds = _bounds(tokens, bits)
        low = ((tokens << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
        counts = np.minimum(counts, 65535).astype("<u2")
        parts = np.flatnonzero(np.diff(bounds))
        cut = [slice(bounds[p], bounds[p + 1]) for p in parts.tolist()]
        return pa.table({"part": pa.array(parts, pa.int32()), "b": pa.array(np.full(len(parts), key[0].as_py()), pa.int64()), "low": pa.array([low[c].tobytes() for c in cut], pa.binary()), "counts": pa.array([counts[c].tobytes() for c in cut], pa.binary())})

    return run


def steps(number: np.ndarray) -> np.ndarray:
    """Numbers of classes in 255 steps: exact up to 200, then four to a doubling."""
    wide = 200 + np.minimum(55, 4 * np.log2(np.maximum(number, 1) / 200))
    return np.where(number <= 200, number, wide).astype(np.uint8)


def _answer(table: pa.Table) -> pa.Table:
    """The numbers of a range's tokens over all blocks, to each block in its own order."""
    lows = [np.frombuffer(x, "<u4") for x in table["low"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u2") for x in table["counts"].to_pylist()])
    _, at = np.unique(np.concatenate(lows), return_inverse=True)
    levels = steps(np.bincount(at, counts))[at]
    ends = np.cumsum([len(x) for x in lows]).tolist()
    rows = [levels[e - len(x) : e].tobytes() for x, e in zip(lows, ends, strict=True)]
    return pa.table({"b": table["b"], "part": table["part"], "levels": pa.array(rows, pa.binary())})


def _enter(n: int, percent: int):
    """Classes with tokens to be found by that other classes have too; all their tokens, and those with their places."""
    least = smallest_size(percent)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        asked = right.filter(pc.is_null(right["part"]))
        answers = right.filter(pc.is_valid(right["part"])).sort_by("part")
        i, k, size, every = _wanted(left, asked, n)
        levels = np.frombuffer(b"".join(answers["levels"].to_pylist()), np.uint8)
        tokens, at = np.unique(every, return_inverse=True)
        if len(tokens) != len(levels):
            raise ValueError("the answers do not fit the block's tokens")
        level, doc = levels[at], np.repeat(np.arange(len(size)), size)
        order = np.lexsort((every, level, doc))
        start = np.cumsum(size) - size
        place = np.arange(len(every)) - np.repeat(start, size)
        look, index = prefix_lengths(size, percent)
        use = (place < look[doc]) & (level[order] > 1) & (size[doc] >= least)
        found, owner, place = every[order][use].view(np.int64), doc[use], place[use]
        rows = np.unique(owner)
        ptr = np.append(np.searchsorted(owner, rows), len(owner))
        cells = np.zeros((len(rows), CELLS), np.int64)
        sets = [every[start[r] : start[r] + size[r]] for r in rows.tolist()]
        for j, x in enumerate(sets):
            cells[j] = np.bincount((x >> np.uint64(57)).astype(np.int64), minlength=CELLS)
        # a cell's count is capped at 255, which stands for "or more"; see bound()
        packed = np.minimum(cells, 255).astype(np.uint8)
        return pa.table({
            "i": pa.array(i[rows], pa.int64()), "k": pa.array(k[rows], pa.int64()), "n": pa.array(size[rows], pa.int64()),
            "cells": pa.array([r.tobytes() for r in packed], pa.binary()),
            "tokens": common.lists(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64), np.concatenate([[0], np.cumsum(size[rows])]), pa.int64()),
            "found": common.lists(found, ptr, pa.int64()),
            "place": common.lists(place, ptr, pa.int64()),
            "index": pa.array(index[rows], pa.int64()),
        })

    return run


def indexed(source: DataFrame, reps: DataFrame, total: int, n: int, percent: int) -> DataFrame:
    """Classes (i, k) that share an indexed token with another class: see _enter for the columns.

    Texts are dealt to blocks by a hash of id and text, once: both uses read the same
    shuffle. A block sends four bytes for each distinct token, and gets one back.
    """
    blocks = max(1, math.ceil(total / BLOCK_TOKENS))
    bits = min(24, max(0, math.ceil(math.log2(max(1, total / RANGE_TOKENS)))))
    block = F.pmod(F.xxhash64(F.lit(5), "i", "k"), F.lit(blocks)).alias("b")
    texts = source.where("i IS NOT NULL").select(block, "i", "k", "t").groupBy("b")
    wanted = reps.select(block, "i", "k")
    asked = texts.cogroup(wanted.groupBy("b")).applyInArrow(_ask(n, bits), "part int, b long, low binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(_answer, "b long, part int, levels binary")
    both = wanted.unionByName(answers, allowMissingColumns=True).select("b", "i", "k", "part", "levels")
    shape = "i long, k long, n long, cells binary, tokens array<long>, found array<long>, place array<long>, index long"
    return texts.cogroup(both.groupBy("b")).applyInArrow(_enter(n, percent), shape)


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most tokens that sets with these cell counts may share; a full cell in both bounds nothing."""
    low = np.minimum(a, b).astype(np.int64)
    return np.where((low == 255).any(1), np.iinfo(np.int64).max, low.sum(1))


def _bounded(percent: int):
    """Keep pairs (ai, ak, bi, bk) whose bound reaches the overlap that their sizes need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in (6, 7))
                na, nb = b.column(4).to_numpy(), b.column(5).to_numpy()
                # 100 * shared >= percent * (na + nb - shared)
                ok = bound(x, y).astype(float) * (100 + percent) >= percent * (na + nb)
                yield b.select([0, 1, 2, 3]).filter(pa.array(ok))

    return run


class _Join:
    """Comparing pairs (a, b) of classes, each a struct of i and k."""

    def __init__(self, classes: DataFrame, percent: int) -> None:
        self.classes, self.percent = classes, percent

    def side(self, name: str, *columns: str) -> DataFrame:
        return self.classes.select(F.col("c").alias(name), *[F.col(x).alias(f"{x}_{name}") for x in columns])

    def reaching(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs that reach the threshold: those that sizes and cells allow, token by token."""
        near = (F.col("n_a") * 100 >= F.col("n_b") * self.percent) & (F.col("n_b") * 100 >= F.col("n_a") * self.percent)
        wide = pairs.join(self.side("b", "n", "cells"), "b").join(self.side("a", "n", "cells"), "a").where(near)
        flat = wide.select("a.i", "a.k", "b.i", "b.k", "n_a", "n_b", "cells_a", "cells_b").toDF("ai", "ak", "bi", "bk", "na", "nb", "ca", "cb")
        some = flat.mapInArrow(_bounded(self.percent), "ai long, ak long, bi long, bk long")
        some = common.stored(some.select(F.struct(F.col("ai").alias("i"), F.col("ak").alias("k")).alias("a"), F.struct(F.col("bi").alias("i"), F.col("bk").alias("k")).alias("b")), "probable")
        both = some.join(self.side("b", "tokens"), "b").join(self.side("a", "tokens"), "a")
        shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
        return common.stored(both.where(shared * (100 + self.percent) >= (F.size("tokens_a") + F.size("tokens_b")) * self.percent).select("a", "b"), "links")


def opened_groups(lookups: DataFrame, classes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(c, h): the look-ups of class c in group h whose bound reaches the overlap that a member needs.

    A group's union is kept in pieces by a hash of the token, as many as its size asks
    for; the overlap with a query is the sum over the pieces.
    """
    held = lookups.select(F.col("h").alias("g")).distinct()
    members = classes.join(groups, "c").join(held, "g", "left_semi")
    sizes = members.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    tokens = common.stored(members.select("g", F.explode("tokens").alias("token")).distinct(), "unions")
    sizes = tokens.groupBy("g").agg(F.ceil(F.count("*") / UNION_TOKENS).cast("long").alias("pieces")).join(sizes, "g")
    sizes = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    salted = tokens.withColumn("salt", F.pmod(F.xxhash64("token"), F.lit(SALTS)))
    pieces = salted.join(sizes, ["g", "salt"]).groupBy("g", F.pmod("token", "pieces").alias("piece")).agg(F.collect_list("token").alias("u"), F.first("pieces").alias("pieces"), F.first("least").alias("least"), F.first("most").alias("most"))
    asked = lookups.join(pieces.withColumnRenamed("g", "h"), "h").join(classes.select("c", "n", "tokens"), "c")
    asked = asked.where((F.col("most") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("least") * percent))
    overlap = asked.groupBy("c", "h").agg(F.sum(F.size(F.array_intersect("tokens", "u"))).alias("most_shared"), F.first("n").alias("n"), F.first("least").alias("least"))
    # the smallest member that could link decides what the bound must reach
    need = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    return overlap.where(F.col("most_shared") * (100 + percent) >= (F.col("n") + need) * percent).select("c", "h")


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document; see the module's text for the method.

    Words are what white space leaves, A-Z lower-cased. Two documents link when
    100 * shared >= percent * union; component_id is the smallest id that links
    reach. Empty and null texts have no grams and link with nothing; texts of
    fewer than n words are one gram. Rows with one id count as one document in
    links (its texts are connected); rows with a null id get a null component.
    Very long texts are single rows of the index like any other; an empty table
    gives an empty result; other columns are not read.

    A large group of copies is reduced to one row for each block that holds some before
    anything is shuffled by its set, and every copy finds its class through that row; a
    large group of near copies meets at its pivots, not pair by pair.
    """
    common.prepare(docs.sparkSession)
    source = docs.select(common.ids(docs, id_col).alias("i"), docs[f"`{text_col}`"].alias("t")).select("i", F.xxhash64("t").alias("k"), "t")
    described = common.stored(source.mapInArrow(_described(n), "i long, k long, n long, h1 long, h2 long, li long, lk long"), "described")
    keys = ["n", "h1", "h2"]
    heads = described.where("i = li AND k = lk").select("i", "k", *keys).distinct()
    classes = heads.groupBy(*keys).agg(F.min(F.struct("i", "k")).alias("c"))
    heads = common.stored(heads.join(classes, keys).select("i", "k", "c", "n"), "heads")
    reps = heads.where("i = c.i AND k = c.k").select("i", "k", "n")
    total = reps.agg(F.sum("n")).first()[0] or 0
    mine = common.stored(indexed(source, reps.drop("n"), total, n, percent).withColumn("c", F.struct("i", "k")).drop("i", "k"), "classes")
    job = _Join(mine, percent)

    # x: whether the class is found by the token, or only looks it up; rest: how many tokens it has after this one
    entries = mine.select("c", "n", "index", F.explode(F.arrays_zip("found", "place")).alias("e")).select(F.col("e.found").alias("token"), "c", (F.col("e.place") < F.col("index")).alias("x"), "n", (F.col("n") - F.col("e.place") - 1).alias("rest"))
    pivots = entries.groupBy("token").agg(F.min(F.when(F.col("x"), F.col("c"))).alias("pivot"), F.min("c").alias("low"), F.max("c").alias("high")).where("pivot IS NOT NULL AND low < high").select("token", "pivot")
    index = common.stored(entries.join(pivots, "token"), "index")
    pairs = index.where("c <> pivot").select(F.greatest("c", "pivot").alias("a"), F.least("c", "pivot").alias("b")).distinct()
    links = job.reaching(pairs)
    # an id with several texts connects their classes
    several = described.where("li IS NOT NULL").groupBy("i").count().where("count > 1").select("i")
    texts = described.join(several, "i").select("i", "li", "lk").distinct().join(heads.select(F.col("i").alias("li"), F.col("k").alias("lk"), "c"), ["li", "lk"])
    same = texts.select("i", F.col("c.i").alias("r")).where("i <> r").select(F.col("i").alias("a"), F.col("r").alias("b"))
    nodes = common.stored(links.select(F.col("a.i").alias("a"), F.col("b.i").alias("b")).union(same), "edges")
    groups = common.connected(nodes)

    # the token-group matrix, for tokens that more than one group holds
    member = mine.select("c", F.col("c.i").alias("node")).join(groups, "node", "left").select("c", F.coalesce("component", "node").alias("g"))
    member = common.stored(member, "members")
    grouped = index.drop("pivot").join(member, "c")
    mixed = grouped.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("token")
    left = common.stored(grouped.join(mixed, "token", "left_semi"), "mixed")
    matrix = left.groupBy("token", "g").agg(F.max("x").alias("gx"), F.max("rest").alias("grest"), F.min("n").alias("gn")).withColumnRenamed("g", "h")
    # of two classes that link, the first token that both have leaves enough of each: others cannot be first
    enough = (1 + F.least("rest", "grest")) * (100 + percent) >= (F.col("n") + F.greatest("gn", F.ceil(F.col("n") * percent / 100))) * percent
    lookups = common.stored(left.join(matrix, "token").where((F.col("g") != F.col("h")) & (F.col("x") | F.col("gx")) & enough).select("c", "h").distinct(), "lookups")
    opened = opened_groups(lookups, mine, member, percent)
    # members of an open group that share a token with the query, early enough in both
    asking = opened.join(left.select("c", "token", "x", "n", "rest"), "c")
    inside = left.select("token", F.col("g").alias("h"), F.col("c").alias("d"), F.col("x").alias("gx"), F.col("n").alias("gn"), F.col("rest").alias("grest"))
    close = asking.join(inside, ["token", "h"]).where((F.col("x") | F.col("gx")) & enough).select(F.greatest("c", "d").alias("a"), F.least("c", "d").alias("b")).distinct()
    more = job.reaching(close)
    components = groups
    if more.limit(1).count():
        components = common.connected(nodes.union(more.select("a.i", "b.i")))

    resolved = heads.select(F.col("i").alias("li"), F.col("k").alias("lk"), F.col("c.i").alias("node")).join(components, "node", "left").select("li", "lk", F.coalesce("component", "node").alias("g"))
    out = described.select("i", "n", "li", "lk").join(resolved, ["li", "lk"], "left")
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(F.least("g", "i"), "i").alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document (the smallest id) of each group of linked ones; null ids stay."""
    found = common.stored(jaccard_join(docs, n, percent, id_col, text_col), "components")
    gone = found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    return docs.join(gone.hint("merge"), id_col, "left_anti").select(*docs.columns)


def brute_force(rows: list[tuple[int, str | None]], n: int = 5, percent: int = 80) -> list[tuple[int, int, int]]:
    """The same by comparing all pairs, for tests."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] == rows[b][0] and sets[a] and sets[b] or sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low: dict[int, int] = {}
    for a, (i, _) in enumerate(rows):
        low[find(a)] = min(low.get(find(a), i), i)
    return [(i, len(s), low[find(a)]) for a, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]
