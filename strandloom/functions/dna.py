"""Column functions over sequences, names and qualities. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base order, complements, the characters that names may not hold.
BASES = "TCAG"
COMPLEMENT = ("TCAG", "AGTC")
UNCLEAN = " :;=%,\\|/\"'"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filter_bases(seq: Column | str, ambiguous_to_n: bool = False) -> Column:
    """Upper-cased T, C, A, G and N; other characters go, run by run, or become N."""
    kept = F.regexp_replace(_c(seq), "[^TCAGNtcagn]", "N") if ambiguous_to_n else F.regexp_replace(_c(seq), "[^TCAGNtcagn]+", "")
    return F.translate(kept, "tcagn", "TCAGN")


def size(seq: Column | str) -> Column:
    return F.length(_c(seq)).cast("long")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(_c(seq), *COMPLEMENT))


def window(seq: Column | str, start: Column | int, end: Column | int) -> Column:
    """Positions start to end, counted from 1 and both included."""
    a = F.lit(start) if isinstance(start, int) else start
    b = F.lit(end) if isinstance(end, int) else end
    return F.substring(_c(seq), a, b - a + 1)


def share(seq: Column | str, bases: str) -> Column:
    """Share of some bases among all characters; null for an empty sequence."""
    kept = F.length(F.regexp_replace(_c(seq), f"[^{bases}]", ""))
    n = F.length(_c(seq))
    return F.when(n > 0, kept / n)


def gc_share(seq: Column | str) -> Column:
    return share(seq, "GC")


def clean_name(name: Column | str) -> Column:
    return F.translate(_c(name), UNCLEAN, "_" * len(UNCLEAN))


def cut_name(header: Column | str) -> Column:
    """A FASTA header up to its first white space."""
    return F.regexp_extract(_c(header), r"^\s?(\S*)", 1)


def wrapped(seq: Column | str, width: int = 80) -> Column:
    """Lines of a sequence; an empty one has none."""
    s = _c(seq)
    n = F.ceil(F.length(s) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(s, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def base_index(base: Column | str) -> Column:
    """0 to 3 in the order of BASES, else 4."""
    at = F.position(_c(base), F.lit(BASES))
    return F.when((at > 0) & (F.length(_c(base)) == 1), at - 1).otherwise(F.lit(4))


def phred_probability(q: Column | str) -> Column:
    return F.when(_c(q) <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(10.0), -_c(q) / 10))


def phred_char(p: Column | str) -> Column:
    """Quality character of an error probability, capped at 93."""
    return F.char(F.lit(33) + F.least(F.lit(93), F.round(-10 * F.log10(_c(p))).cast("int")))


def fastq_id(genome: Column | str, chrom: Column | str, start: Column | str, strand: Column | str, mate: Column | str | None = None) -> Column:
    head = F.concat_ws("-", _c(genome), _c(chrom), _c(start).cast("string"), _c(strand))
    return F.concat(F.lit("@"), head) if mate is None else F.concat(F.lit("@"), head, F.lit("/"), _c(mate).cast("string"))


def padded_read(seq: Column | str, start: Column | str, n: Column | int) -> Column:
    """n bases from a 0-based start, filled with N past the end."""
    k = F.lit(n) if isinstance(n, int) else n
    return F.rpad(F.substring(_c(seq), _c(start).cast("int") + 1, k), k, F.lit("N"))


def even_part(total: int, parts: int, i: Column | str) -> Column:
    """Size of part i when total is dealt to parts as evenly as whole numbers allow."""
    return F.lit(total // parts) + F.when(_c(i) < total % parts, 1).otherwise(0)
