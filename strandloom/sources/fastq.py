"""Writing reads as FASTQ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reads import records
from .files import write_lines

#: Both mates of a pair agree in these, so files of first and of second mates have one order.
ORDER = ["hap", "chrom", "chunk", "n"]


def write_fastq(reads: DataFrame, prefix: str, paired: bool = False, by_haplotype: bool = False, compress: str | None = None, overwrite: bool = False, single_file: bool = True) -> list[str]:
    """<prefix>_R1.fq and _R2.fq, or <prefix>_<hap>_R1.fq for each haplotype; line for line, mates belong together."""
    lines = records(reads, paired).persist()
    try:
        haps = [r[0] for r in lines.select("hap").distinct().orderBy("hap").collect()] if by_haplotype else [None]
        out = []
        for h in haps:
            for m in (1, 2) if paired else (1,):
                part = lines.where((F.col("mate") == m) & (F.lit(True) if h is None else F.col("hap") == h))
                name = f"{prefix}_R{m}.fq" if h is None else f"{prefix}_{h}_R{m}.fq"
                out.append(write_lines(part, ORDER, name, compress, overwrite, single_file))
        return out
    finally:
        lines.unpersist()
