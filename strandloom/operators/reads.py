"""Sequencing reads: short paired reads with quality profiles, and long reads with passes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna, rng
from ..plans.checks import number, whole
from ..plans.models import lower_gamma
from ..sources.profiles import Profile, falling

#: chunk and n number the reads of a sequence; both mates of a pair have the same.
READ = "hap string, chrom string, start long, strand string, mate int, seq string, qual string, chunk long, n long"
#: Bases that an insertion, a deletion, a substitution and no error write.
_WRITTEN = np.array([2, 0, 1, 1])
#: Reads that one task makes in one go for one sequence.
CHUNK = 20_000
#: Blocks of chromosomes whose sizes the driver knows, for each haplotype.
BLOCKS = 1_024
_COMPLEMENT = bytes.maketrans(b"TCAG", b"AGTC")
_BASES = np.frombuffer(b"TCAG", np.uint8)
_CODE = np.full(256, 4, np.int8)
for _i, _b in enumerate(b"TCAG"):
    _CODE[_b] = _i


def mate_columns(fragments: DataFrame, read_length: int, matepair: bool = False) -> DataFrame:
    """Two rows per fragment: mates on opposite strands, facing inwards, or outwards if matepair."""
    both = fragments.withColumnRenamed("strand", "template").withColumn("mate", F.explode(F.array(F.lit(1), F.lit(2))))
    flipped = F.when(F.col("template") == "F", "R").otherwise("F")
    both = both.withColumn("strand", F.when(F.col("mate") == 1, F.col("template")).otherwise(flipped))
    left_end = (F.col("strand") == "F") != F.lit(matepair)
    n = F.lit(read_length)
    raw = F.when(left_end, F.substring(F.col("fragment"), F.lit(1), n)).otherwise(F.right(F.col("fragment"), n))
    return both.withColumn("read", F.when(F.col("strand") == "R", dna.reverse_complement(raw)).otherwise(raw))


@dataclass(frozen=True)
class Illumina:
    """Settings of short reads; n_reads counts both mates, and duplicates."""

    # The usual defaults.
    read_length: int = 100
    paired: bool = True
    matepair: bool = False
    frag_mean: float = 400
    frag_sd: float = 100
    frag_min: int | None = None
    frag_max: int | None = None
    ins_prob: tuple[float, float] = (0.00009, 0.00015)
    del_prob: tuple[float, float] = (0.00011, 0.00023)
    prob_dup: float = 0.02
    profiles: tuple[Profile, Profile] | None = None
    barcodes: Sequence[str] = field(default=())

    def __post_init__(self) -> None:
        whole("read_length", self.read_length, 1)
        number("frag_mean", self.frag_mean, 1)
        number("frag_sd", self.frag_sd, 1e-9)
        for i, d in zip(self.ins_prob, self.del_prob, strict=True):
            number("ins_prob", i, 0, 1)
            number("ins_prob + del_prob", i + number("del_prob", d, 0, 1), 0, 1)
        if not 0 <= number("prob_dup", self.prob_dup) < 1:
            raise ValueError("prob_dup must be at least 0 and below 1")
        if any(len(b) >= self.read_length or b.strip("TCAG") for b in self.barcodes):
            raise ValueError("barcodes must be shorter than reads and hold T, C, A and G")
        if self.matepair and not self.paired:
            raise ValueError("mate pairs are paired")


@dataclass(frozen=True)
class PacBio:
    """Settings of long reads."""

    # The published curves of passes and errors.
    chi2_s: tuple[float, ...] = (0.01214, -5.12, 675.0, 48303.0732881, 1.4691051212330266)
    chi2_n: tuple[float, ...] = (0.00189237136, 2.53944970, 5500.0)
    max_passes: int = 40
    sqrt_params: tuple[float, float] = (0.5, 0.2247)
    norm_params: tuple[float, float] = (0.0, 0.2)
    prob_thresh: float = 0.2
    ins_prob: float = 0.11
    del_prob: float = 0.04
    sub_prob: float = 0.01
    min_length: int = 50
    lognorm: tuple[float, float, float] = (0.200110276521, -10075.4363813, 17922.611306)
    lengths: tuple[Sequence[int], Sequence[float]] | None = None
    prob_dup: float = 0.0

    def __post_init__(self) -> None:
        p = [number(n, x, 0, 1) for n, x in (("ins_prob", self.ins_prob), ("del_prob", self.del_prob), ("sub_prob", self.sub_prob))]
        if max(p) >= 1 or sum(p) > 1:
            raise ValueError("error probabilities must be below 1 and add up to no more than 1")
        number("prob_thresh", self.prob_thresh, 1e-9, 1)
        whole("min_length", self.min_length, 1)
        if not 0 <= number("prob_dup", self.prob_dup) < 1:
            raise ValueError("prob_dup must be at least 0 and below 1")


def allocate(sequences: DataFrame, n: int, weights: dict[str, float] | None, seed: int) -> DataFrame:
    """(hap, chrom, n, chunk): a multinomial over haplotypes, then over their chromosomes by length.

    Chromosomes are dealt to a fixed number of blocks by name. Only the sizes of blocks
    come to the driver, which splits the reads over them; each block splits its own over
    its chromosomes in a task. That is the same multinomial, and does not depend on how
    the rows are partitioned. Large numbers are cut into chunks, so one sequence that
    gets most reads is read by many tasks. Null or empty sequences get no reads.
    """
    spark = sequences.sparkSession
    block = F.pmod(F.xxhash64("chrom"), F.lit(BLOCKS)).cast("int")
    sizes = sequences.select("hap", "chrom", F.coalesce(F.length("seq"), F.lit(0)).cast("long").alias("size"), block.alias("block"))
    totals: dict[str, list[tuple[int, int]]] = {}
    for r in sizes.groupBy("hap", "block").agg(F.sum("size").alias("size")).orderBy("hap", "block").collect():
        totals.setdefault(r["hap"], []).append((r["block"], r["size"]))
    w = np.array([1.0 if weights is None else number("weight", weights[h], 0) for h in totals])
    if not w.sum():
        raise ValueError("there is no haplotype to read from")
    g = rng.generator(seed, "reads")
    rows = []
    for (h, blocks), k in zip(totals.items(), g.multinomial(n, w / w.sum()), strict=True):
        length = np.array([size for _, size in blocks], float)
        if k and not length.sum():
            raise ValueError(f"haplotype {h} has no bases")
        if k:
            rows += [(h, i, int(m)) for (i, _), m in zip(blocks, g.multinomial(k, length / length.sum()), strict=True) if m]

    def split(key, f):
        import pandas as pd

        f = f.sort_values("chrom")
        length = f["size"].to_numpy(float)
        dealt = rng.generator(seed, "reads", *key).multinomial(int(f["reads"].iloc[0]), length / length.sum())
        out = [(key[0], c, min(CHUNK, m - i), i // CHUNK) for c, m in zip(f["chrom"], dealt.tolist(), strict=True) for i in range(0, m, CHUNK)]
        return pd.DataFrame(out, columns=["hap", "chrom", "n", "chunk"])

    dealt = spark.createDataFrame(rows, "hap string, block int, reads long")
    # a number of its own here too: the sizes are few bytes, and adaptive execution would split all blocks in one task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sizes.join(F.broadcast(dealt), ["hap", "block"]).repartition(parts, "hap", "block").groupBy("hap", "block").applyInPandas(split, "hap string, chrom string, n long, chunk long")


class Gathered:
    """Reads on their way out, as columns of READ; seq and qual are ASCII bytes."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in READ.split(", ")]

    def __len__(self) -> int:
        return len(self.columns[0])

    def add(self, *row) -> None:
        for column, x in zip(self.columns, row, strict=True):
            column.append(x)

    def batch(self):
        """An Arrow batch of what has been added."""
        return _batch([*self.columns[:5], *map(_ascii, self.columns[5:7]), *self.columns[7:]])


def _batch(columns):
    import pyarrow as pa

    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in READ.split(", ")])


def _ascii(texts: list[bytes]):
    return _strings(np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts)))


def _strings(data: np.ndarray, lengths: np.ndarray):
    """An Arrow array of ASCII strings that lie one after another."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(lengths)])
    if offsets[-1] < 2**31:
        return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _made(sequences: DataFrame, plan: DataFrame, make, gathered=Gathered) -> DataFrame:
    """make(out, hap, chrom, seq, n, chunk) adds the reads of every row; what goes out is gathered to about CHUNK / 4 reads.

    Batches that come in are bounded by Spark's bytes for Arrow batches.
    """

    def run(batches):
        out = gathered()
        for f in batches:
            for h, c, s, n, k in zip(*[f.column(x).to_pylist() for x in ("hap", "chrom", "seq", "n", "chunk")], strict=True):
                make(out, h, c, s, n, k)
                if len(out) >= CHUNK // 4:
                    yield out.batch()
                    out = gathered()
        yield out.batch()

    rows = plan.join(sequences.select("hap", "chrom", "seq"), ["hap", "chrom"]).select("hap", "chrom", "seq", "n", "chunk")
    # a number of its own keeps adaptive execution from merging small partitions: few bytes here are much work
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "hap", "chrom", "chunk").mapInArrow(run, READ)


def _with_errors(seq: bytes, n: int, ins: float, dele: float, g: np.random.Generator) -> list[tuple[int, str]]:
    """Indels of a read over its fragment: (position, inserted base or empty for a deletion)."""
    out: list[tuple[int, str]] = []
    if not ins + dele:
        return out
    have, at = 0, 0
    u = g.random(len(seq))
    if not len(seq) or u[:n].min() > ins + dele:
        return out
    while have < n and at < len(seq):
        if u[at] > ins + dele:
            have += 1
        elif u[at] > ins:
            out.append((at, ""))
        elif have + 1 < n:
            out.append((at, chr(_BASES[g.integers(4)])))
            have += 2
        else:
            have += 1
        at += 1
    return out


class Qualities:
    """Profiles of both mates as tables of one row for each mate, base and position, so that many reads are looked up at once."""

    def __init__(self, profiles: Sequence[Profile]) -> None:
        self.length = np.array([p.length for p in profiles])
        self.first = np.concatenate([[0], np.cumsum(4 * self.length)])[:-1]
        rows = [(p.quals[b][at], p.cumulative[b][at]) for p in profiles for b in range(4) for at in range(p.length)]
        most = max(len(c) for _, c in rows)
        self.steps = [2**i for i in range(most.bit_length() - 1, -1, -1)]
        self.width = 2 * self.steps[0]
        self.upto = np.full((len(rows), self.width), np.inf)
        self.quals = np.zeros((len(rows), self.width), np.int64)
        for i, (q, c) in enumerate(rows):
            self.upto[i, : len(c)] = c
            self.quals[i, : len(q)] = q
            self.quals[i, len(q) :] = q[-1]
        chance = {q: 10 ** (-q / 10) if q else 1.0 for q in np.unique(self.quals).tolist()}
        self.chance = np.array([chance[q] for q in self.quals.ravel().tolist()])
        self.marks = (33 + np.minimum(self.quals, 93)).astype(np.uint8).ravel()
        self.upto = self.upto.ravel()

    def __call__(self, read: np.ndarray, mate: np.ndarray, place: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A quality for each base at its place in a read, and a mismatch with its chance; N has a low one and stays."""
        code = _CODE[read].astype(np.int64)
        known = code < 4
        at = np.minimum(place, self.length[mate] - 1)
        base = (self.first[mate] + np.where(known, code, 0) * self.length[mate] + at) * self.width
        found = base.copy()
        for step in self.steps:  # how many cumulative shares are below u
            found += step * (self.upto[found + (step - 1)] < u)
        wrong = known & (v < self.chance[found])
        return np.where(wrong, _BASES[(code + 1 + w) % 4], read), np.where(known, self.marks[found], (33 + (u * 10).astype(np.int64)).astype(np.uint8))


class Drawn(Gathered):
    """Reads whose qualities are yet to be looked up: what was drawn for them is kept until all go out at once."""

    def __init__(self, qualities: Qualities) -> None:
        super().__init__()
        self.qualities, self.uv, self.w = qualities, [], []

    def batch(self):
        reads, step = self.columns[5], CHUNK // 4
        made = [self._made(slice(i, i + step)) for i in range(0, len(reads), step)]
        made, quals = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.uint8),) * 2
        n = np.fromiter(map(len, reads), np.int64, len(reads))
        return _batch([*self.columns[:5], _strings(made, n), _strings(quals, n), *self.columns[7:]])

    def _made(self, some: slice) -> tuple[np.ndarray, np.ndarray]:
        """Bases and qualities of some reads, one after another; arrays of numbers are those of so many reads at a time."""
        reads = self.columns[5][some]
        n = np.fromiter(map(len, reads), np.int64, len(reads))
        first = np.repeat(np.cumsum(n) - n, n)
        read = np.frombuffer(b"".join(reads), np.uint8)
        each, uv = np.arange(len(read)), np.concatenate(self.uv[some])
        at = each + first  # each read's u come before its v
        return self.qualities(read, np.repeat(np.array(self.columns[4][some], np.int64) - 1, n), each - first, uv[at], uv[at + np.repeat(n, n)], np.concatenate(self.w[some]))


def illumina(sequences: DataFrame, n_reads: int, settings: Illumina | None = None, weights: dict[str, float] | None = None, barcodes: dict[str, str] | None = None, seed: int = 0) -> DataFrame:
    """Short reads from (hap, chrom, seq); the total is n_reads, mates and duplicates included."""
    s = settings or Illumina()
    profiles = s.profiles or (falling(s.read_length), falling(s.read_length))
    mates = 2 if s.paired else 1
    if whole("n_reads", n_reads, 1) % mates:
        raise ValueError("the number of paired reads must be even")
    low = s.frag_min if s.frag_min is not None else s.read_length
    shape, scale = (s.frag_mean / s.frag_sd) ** 2, s.frag_sd**2 / s.frag_mean

    qualities = Qualities(profiles[:mates])
    limit = math.inf if s.frag_max is None or not s.frag_max else s.frag_max

    def make(out: Drawn, hap: str, chrom: str, seq: str, n: int, chunk: int) -> None:
        g = rng.generator(seed, "illumina", hap, chrom, chunk)
        bar = (barcodes or {}).get(hap, "").encode()
        raw, made = seq.encode("ascii", "replace"), 0
        gamma, random = g.gamma, g.random
        while made < n:
            size = min(int(min(max(gamma(shape, scale), low), limit)), len(raw))
            start = int(random() * (len(raw) - size + 1))
            fragment = raw[start : start + size]
            while True:
                template(out, hap, chrom, fragment, start, bar, g, chunk, made)
                made += 1
                if made >= n or random() >= s.prob_dup:
                    break

    def template(out: Drawn, hap: str, chrom: str, fragment: bytes, start: int, bar: bytes, g, chunk: int, made: int) -> None:
        strand = "F" if g.random() < 0.5 else "R"
        for m in range(mates):
            side = strand if m == 0 else ("R" if strand == "F" else "F")
            left = (side == "F") != s.matepair
            errors = _with_errors(fragment, s.read_length, s.ins_prob[m], s.del_prob[m], g)
            span = min(s.read_length, len(fragment))
            if errors:
                dels = sum(not b for _, b in errors)
                span = min(s.read_length + dels - (len(errors) - dels), len(fragment))
            span = max(span - len(bar), 0)
            at = 0 if left else len(fragment) - span
            read = fragment[at : at + span]
            if side == "R":
                read = read.translate(_COMPLEMENT)[::-1]
            read = bar + read
            for p, b in reversed(errors):  # from the end, so that positions stay right
                if p < len(read):
                    read = read[: p + 1] + b.encode() + read[p + 1 :] if b else read[:p] + read[p + 1 :]
            read = read[: s.read_length]
            out.uv.append(g.random(2 * len(read)))
            out.w.append(g.integers(0, 3, len(read)))
            out.add(hap, chrom, start + at, side, m + 1, read, None, chunk, made)

    return _made(sequences, allocate(sequences, n_reads // mates, weights, seed), make, lambda: Drawn(qualities))


def least_exponent(p: tuple[float, float, float], limit: float) -> float:
    """The exponent at which the error probabilities, raised to it, add up to the limit."""
    low, high = 0.0, 1.0
    while sum(x**high for x in p) > limit and high < 1e6:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        if sum(x**mid for x in p) > limit:
            low = mid
        else:
            high = mid
    return high


def pacbio(sequences: DataFrame, n_reads: int, settings: PacBio | None = None, weights: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """Long reads from (hap, chrom, seq): lengths, passes, errors by side of the read, duplicates."""
    s = settings or PacBio()
    probs = (s.ins_prob, s.del_prob, s.sub_prob)
    least = least_exponent(probs, s.prob_thresh)
    normal = NormalDist(s.norm_params[0], s.norm_params[1])

    def length(size: int, g) -> int:
        if s.lengths:
            w = np.array(s.lengths[1], float)
            n = int(g.choice(s.lengths[0], p=w / w.sum()))
        else:
            sigma, loc, scale = s.lognorm
            for _ in range(10):
                n = int(g.lognormal(math.log(scale), sigma) + loc)
                if n >= s.min_length:
                    break
            n = max(n, s.min_length)
        return max(1, min(n, size))

    def passes(n: int, g) -> float:
        df = max(0.001, s.chi2_n[0] * min(n, s.chi2_n[2]) + s.chi2_n[1])
        s0, s1, s2, s3, s4 = s.chi2_s
        scale = max(0.001, s0 * n - s1 if n <= s2 else s3 / n**s4)
        x = g.chisquare(df)
        while lower_gamma(df / 2, x / 2) > 0.9925:  # beyond that quantile
            x = g.chisquare(df)
        return min(1 + scale * x, s.max_passes)

    def chances(k: float, g) -> tuple[float, float, float]:
        base = math.sqrt(k + s.sqrt_params[0]) - s.sqrt_params[1]
        sg = 1 / (1 + 2 ** (-2.5 / 3 * k + 6.5 / 3))
        low = normal.cdf((least - base) / sg)
        u = min(max(low + g.random() * (1 - low), 1e-12), 1 - 1e-12)
        e = max(0.6, normal.inv_cdf(u) * sg + base)
        return tuple(p**e for p in probs)

    def drawn(n: int, p: tuple[float, float, float], g) -> np.ndarray:
        """Events (0 insertion, 1 deletion, 2 substitution, 3 none) that write at least n bases."""
        kinds, written = np.zeros(0, np.int64), 0
        while written < n:
            more = np.searchsorted(np.cumsum(p), g.random(n - written + 20), "right")
            kinds = np.concatenate([kinds, more])
            written = int(_WRITTEN[kinds].sum())
        return kinds[: int(np.searchsorted(np.cumsum(_WRITTEN[kinds]), n)) + 1]

    def events(n: int, spare: int, split: int, left, right, g) -> np.ndarray:
        """Events of a read of n bases. A deletion needs a spare base beyond the read's, and every insertion gives one."""
        kinds = drawn(split, left, g) if split else np.zeros(0, np.int64)
        rest = n - int(_WRITTEN[kinds].sum())
        if rest > 0:
            kinds = np.concatenate([kinds, drawn(rest, right, g)])
        if _WRITTEN[kinds].sum() > n:  # an insertion that would be one base too many
            kinds[-1] = 3
        room = spare + np.cumsum((kinds == 0).astype(np.int64) - (kinds == 1))
        if len(room) and room.min() < 0:
            kept, left_over = [], spare
            for k in kinds.tolist():
                left_over += (k == 0) - (k == 1)
                if left_over < 0:
                    left_over = 0
                else:
                    kept.append(k)
            kinds = np.array(kept, np.int64)
        return kinds

    def written(source: np.ndarray, kinds: np.ndarray, g) -> bytes:
        """The source's bases with the events on them."""
        bases, code = source.copy(), _CODE[source]
        at = np.flatnonzero((kinds == 2) & (code < 4))
        bases[at] = _BASES[(code[at] + 1 + g.integers(0, 3, len(at))) % 4]
        times = _WRITTEN[kinds]
        out = np.repeat(bases, times)
        inserted = np.cumsum(times)[kinds == 0] - 1
        out[inserted] = _BASES[g.integers(0, 4, len(inserted))]
        return out.tobytes()

    def make(out: Gathered, hap: str, chrom: str, seq: str, n: int, chunk: int) -> None:
        g = rng.generator(seed, "pacbio", hap, chrom, chunk)
        raw, done = np.frombuffer(seq.encode(), np.uint8), 0
        while done < n:
            size, u = length(len(raw), g), g.random()
            while True:
                k = passes(size, g)
                w, f = int(k), k - int(k)
                a, b = (w + 1, w) if w % 2 == 0 else (w, w + 1)
                split = round((f if w % 2 == 0 else 1 - f) * size)
                left, right = chances(a, g), chances(b, g)
                # errors come first: they decide how many bases of the chromosome the read takes, and so where it may start
                kinds = events(size, len(raw) - size, split, left, right, g)
                start = int(u * (len(raw) - len(kinds) + 1))
                source, forward = raw[start : start + len(kinds)], g.random() < 0.5
                if not forward:
                    source = np.frombuffer(source.tobytes().translate(_COMPLEMENT), np.uint8)[::-1]
                made = written(source, kinds, g)
                marks = [bytes([33 + min(93, round(-10 * math.log10(max(sum(x), 1e-12))))]) for x in (left, right)]
                split = min(split, len(made))
                out.add(hap, chrom, start, "F" if forward else "R", 1, made, marks[0] * split + marks[1] * (len(made) - split), chunk, done)
                done += 1
                if done >= n or g.random() >= s.prob_dup:
                    break

    return _made(sequences, allocate(sequences, whole("n_reads", n_reads, 1), weights, seed), make)


def records(reads: DataFrame, paired: bool = False) -> DataFrame:
    """The four lines of each read as one string, with its haplotype, mate and number."""
    head = dna.fastq_id("hap", dna.clean_name("chrom"), "start", "strand", "mate" if paired else None)
    return reads.select("hap", "chrom", "chunk", "n", "mate", F.concat_ws("\n", head, "seq", F.lit("+"), "qual").alias("value"))
