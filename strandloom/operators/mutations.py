"""Haplotypes as mutations of a genome: (hap_id, chrom_id, old_pos, ref_len, alt).

ref_len reference bases from the 0-based old_pos are replaced by alt. A substitution has
ref_len 1 and one base, an insertion keeps its reference base in front, a deletion has an
empty alt. Mutations of one haplotype and chromosome do not overlap.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna

SCHEMA = "hap_id int, chrom_id long, old_pos long, ref_len int, alt string"
KEYS = ("hap_id", "chrom_id")


def size_change() -> Column:
    return F.length("alt") - F.col("ref_len")


def with_new_pos(mutations: DataFrame) -> DataFrame:
    """Adds size_mod and new_pos, the position in the haplotype."""
    w = Window.partitionBy(*KEYS).orderBy("old_pos").rowsBetween(Window.unboundedPreceding, -1)
    m = mutations.withColumn("size_mod", size_change())
    return m.withColumn("new_pos", F.col("old_pos") + F.coalesce(F.sum("size_mod").over(w), F.lit(0)))


def every(chroms: DataFrame, haps: DataFrame) -> DataFrame:
    """Every haplotype (hap_id) of every row of chroms, which is read and computed once, however many haplotypes there are."""
    ids = haps.agg(F.collect_list("hap_id").alias("hap_ids"))  # one row
    return chroms.join(F.broadcast(ids)).select(F.explode("hap_ids").alias("hap_id"), *chroms.columns)


def sizes(chroms: DataFrame, haps: DataFrame, mutations: DataFrame) -> DataFrame:
    """(hap_id, chrom_id, size) of every haplotype and chromosome."""
    change = mutations.groupBy(*KEYS).agg(F.sum(size_change()).alias("change"))
    base = every(chroms.select("chrom_id", dna.size("seq").alias("size")), haps)
    return base.join(change, list(KEYS), "left").select(*KEYS, (F.col("size") + F.coalesce("change", F.lit(0))).alias("size"))


def applied(ref: Column, mutations: Column, offset: Column | int = 0) -> Column:
    """ref with a sorted array of (old_pos, ref_len, alt) applied; ref begins at position offset."""
    o = F.lit(offset) if isinstance(offset, int) else offset
    n = F.size(mutations)

    def at(x: Column) -> Column:
        return (x["old_pos"] - o).cast("int")

    def piece(x: Column, i: Column) -> Column:
        start = at(x) + x["ref_len"] + 1
        end = F.when(i + 1 < n, at(F.get(mutations, i + 1))).otherwise(F.length(ref))
        return F.concat(x["alt"], F.substring(ref, start, F.greatest(end - start + 1, F.lit(0))))

    first = at(F.get(mutations, F.lit(0)))
    return F.when(n > 0, F.concat(F.substring(ref, F.lit(1), first), F.array_join(F.transform(mutations, piece), ""))).otherwise(ref)


def gathered(mutations: DataFrame, *keys: str) -> DataFrame:
    """One row per key with the sorted array of its mutations (at most one per base of a chromosome)."""
    return mutations.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("old_pos", "ref_len", "alt"))).alias("ms"))


def materialize(chroms: DataFrame, haps: DataFrame, mutations: DataFrame) -> DataFrame:
    """(hap_id, chrom_id, seq): one shuffle by haplotype and chromosome, and each sequence built once."""
    ms = gathered(mutations, *KEYS)
    base = every(chroms.select("chrom_id", "seq"), haps)
    empty = F.array().cast("array<struct<old_pos:bigint,ref_len:int,alt:string>>")
    return base.join(ms, list(KEYS), "left").select(*KEYS, applied(F.col("seq"), F.coalesce("ms", empty)).alias("seq"))


def spectrum(chroms: DataFrame, mutations: DataFrame) -> DataFrame:
    """(kind, ref_base, detail, n): substitutions by base and target, insertions and deletions by base and size."""
    m = mutations.join(chroms.select("chrom_id", "seq"), "chrom_id")
    base = F.substring(F.col("seq"), F.col("old_pos").cast("int") + 1, F.lit(1))
    d = size_change()
    kind = F.when(d == 0, "sub").when(d > 0, "ins").otherwise("del")
    detail = F.when(d == 0, F.col("alt")).otherwise(F.abs(d).cast("string"))
    return m.select(kind.alias("kind"), base.alias("ref_base"), detail.alias("detail")).groupBy("kind", "ref_base", "detail").agg(F.count("*").alias("n"))


# --- edits in the coordinates of the growing haplotype ---


class Pieces:
    """A haplotype chromosome as slices of the reference and literal strings, so that an edit is a splice."""

    def __init__(self, ref: str, mutations: Iterable[tuple[int, int, str]] = ()) -> None:
        self.ref = ref
        self.parts: list[tuple] = []  # (start, end) of the reference, or (text,)
        at = 0
        for p, n, alt in sorted(mutations):
            self._push((at, p))
            if alt:
                self.parts.append((alt,))
            at = p + n
        self._push((at, len(ref)))
        self.sizes = list(map(self._size, self.parts))
        self.total = sum(self.sizes)

    def _push(self, part: tuple) -> None:
        if len(part) == 1 or part[1] > part[0]:
            self.parts.append(part)

    @staticmethod
    def _size(part: tuple) -> int:
        return len(part[0]) if len(part) == 1 else part[1] - part[0]

    def __len__(self) -> int:
        return self.total

    def _split(self, pos: int) -> int:
        """Index of the part that begins at pos, after splitting the one that holds it."""
        ends = list(accumulate(self.sizes))
        i = bisect.bisect_right(ends, pos)
        if i == len(self.parts):
            return i
        inside = pos - (ends[i - 1] if i else 0)
        if inside:
            part = self.parts[i]
            halves = [(part[0][:inside],), (part[0][inside:],)] if len(part) == 1 else [(part[0], part[0] + inside), (part[0] + inside, part[1])]
            self.parts[i : i + 1] = halves
            self.sizes[i : i + 1] = [inside, self.sizes[i] - inside]
            i += 1
        return i

    def _replace(self, pos: int, n: int, text: str) -> None:
        i = self._split(pos)
        j = self._split(pos + n) if n else i
        self.total += len(text) - sum(self.sizes[i:j])
        self.parts[i:j] = [(text,)] if text else []
        self.sizes[i:j] = [len(text)] if text else []

    def _check(self, pos: int) -> None:
        if not 0 <= pos < len(self):
            raise ValueError(f"position {pos} is outside the chromosome")

    def substitute(self, pos: int, base: str) -> None:
        self._check(pos)
        self._replace(pos, 1, base)

    def insert(self, pos: int, bases: str) -> None:
        """After the base at pos."""
        self._check(pos)
        self._replace(pos + 1, 0, bases)

    def start_with(self, bases: str) -> None:
        """Before all other bases."""
        self._replace(0, 0, bases)

    def delete(self, pos: int, n: int) -> None:
        """n bases from pos, or as many as there are."""
        self._check(pos)
        self._replace(pos, min(n, len(self) - pos), "")

    def text(self) -> str:
        return "".join(p[0] if len(p) == 1 else self.ref[p[0] : p[1]] for p in self.parts)

    def mutations(self) -> list[tuple[int, int, str]]:
        """Canonical (old_pos, ref_len, alt); what equals the reference is left out."""
        out: list[tuple[int, int, str]] = []
        at, literal = 0, []
        for part in [*self.parts, (len(self.ref), len(self.ref))]:
            if len(part) == 1:
                literal.append(part[0])
                continue
            if part[0] > at or literal:
                out += canonical(self.ref, at, part[0], "".join(literal))
            at, literal = part[1], []
        return out


def canonical(ref: str, start: int, end: int, text: str) -> list[tuple[int, int, str]]:
    """Mutations that turn ref[start:end] into text: substitutions, then one insertion or deletion."""
    same = min(end - start, len(text))
    out = [(start + i, 1, text[i]) for i in range(same) if ref[start + i] != text[i]]
    if end - start > same:
        out.append((start + same, end - start - same, ""))
    elif len(text) > same:
        more = text[same:]
        if same:  # on the last replaced base
            if out and out[-1][0] == end - 1:
                out.pop()
            out.append((end - 1, 1, text[same - 1] + more))
        elif start:
            out.append((start - 1, 1, ref[start - 1] + more))
        elif ref:
            out.append((0, 1, more + ref[0]))
    return out


def edit(chroms: DataFrame, mutations: DataFrame, edits: DataFrame, wrap: bool = False) -> DataFrame:
    """Mutations after edits (hap_id, chrom_id, seq_no, kind sub | ins | del, pos, text, n), in order of seq_no.

    Positions are those of the haplotype as edited so far, so edits of one haplotype and
    chromosome are folded in one task; different ones run apart. A position outside is an
    error, or with wrap counts modulo the size at that moment; then a chromosome that has
    become empty takes insertions only, and one without reference bases stays as it is.
    """
    e = edits.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("seq_no", "kind", "pos", "text", "n"))).alias("es"))
    rows = e.join(gathered(mutations, *KEYS), list(KEYS), "left").join(chroms.select("chrom_id", "seq"), "chrom_id")

    def run(batches):
        import pyarrow as pa

        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        for f in batches:
            out: list[list] = [[], [], [], [], []]
            keys = [f.column(c).to_pylist() for c in (*KEYS, "seq")]
            for h, c, seq, es, ms in zip(*keys, _rows(f.column("es")), _rows(f.column("ms")), strict=True):
                p = Pieces(seq, ms)
                for _, kind, pos, text, n in es:
                    if wrap:
                        if not len(p):
                            if kind == "ins" and seq:
                                p.start_with(text)
                            continue
                        pos %= len(p)
                    if kind == "sub":
                        p.substitute(pos, text)
                    elif kind == "ins":
                        p.insert(pos, text)
                    else:
                        p.delete(pos, n)
                found = merged(p.mutations())
                if found:
                    for column, more in zip(out, ([h] * len(found), [c] * len(found), *zip(*found, strict=True)), strict=True):
                        column += more
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["hap_id", "chrom_id", "old_pos", "ref_len", "alt"])

    edited = rows.select(*KEYS, "es", "ms", "seq").mapInArrow(run, SCHEMA)
    return mutations.join(e.select(*KEYS), list(KEYS), "left_anti").select(*edited.columns).unionByName(edited)


def _rows(lists) -> Iterable[list[tuple]]:
    """Of an Arrow column of arrays of structs, a list of tuples for each row, empty for a null; by columns, as rows are slow."""
    structs = lists.flatten()
    rows = list(zip(*[x.to_pylist() for x in structs.flatten()], strict=True))
    at = 0
    for n in lists.value_lengths().to_pylist():
        yield rows[at : at + (n or 0)]
        at += n or 0


def merged(ms: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Two mutations of one reference base (a literal on either side of it) as one."""
    out: list[tuple[int, int, str]] = []
    for p, n, alt in ms:
        if out and n and out[-1][0] == p and out[-1][1] == n:
            out[-1] = (p, n, out[-1][2] + alt[1:] if len(alt) > 1 else out[-1][2])
        else:
            out.append((p, n, alt))
    return out
