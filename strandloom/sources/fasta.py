"""FASTA files, with or without an index, and writing them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators.genome import Genome
from .files import write_lines

FAI = "name string, length long, offset long, line_bases long, line_bytes long"


def read_fasta(spark: SparkSession, paths: str | Sequence[str], cut_names: bool = False, ambiguous_to_n: bool = False) -> Genome:
    """Plain or gzipped files, one after another; a record begins with > at the start of a line.

    Letters are upper-cased; those other than T, C, A, G and N go, or become N.
    """
    parts = []
    for f, path in enumerate([paths] if isinstance(paths, str) else paths):
        # a record is what stands between two ">" at line starts, so long files are split between records
        text = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
        parts.append(text.select(F.lit(f).alias("f"), F.monotonically_increasing_id().alias("r"), F.regexp_replace("value", "^>", "").alias("v")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    head = F.substring_index("v", "\n", 1)
    seq = F.when(F.instr("v", "\n") > 0, F.substring(F.col("v"), F.instr("v", "\n") + 1, F.length("v")))
    name = dna.cut_name(head) if cut_names else F.trim(F.regexp_replace(head, "\r$", ""))
    rows = rows.select("f", "r", name.alias("name"), dna.filter_bases(F.regexp_replace(F.coalesce(seq, F.lit("")), r"\s", ""), ambiguous_to_n).alias("seq"))
    order = rows.select("f", "r").rdd.map(tuple).sortBy(lambda x: x).zipWithIndex().map(lambda x: (*x[0], x[1]))
    numbered = spark.createDataFrame(order, "f int, r long, chrom_id long")
    return Genome(rows.join(numbered, ["f", "r"]).select("chrom_id", "name", "seq"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=FAI)


def read_indexed(spark: SparkSession, path: str, index: str, cut_names: bool = False) -> Genome:
    """Records of an uncompressed file by its index: each is read in its own range of bytes.

    The file must be one that tasks can open by this path.
    """
    rows = read_index(spark, index).rdd.zipWithIndex().map(lambda x: (x[1], *x[0]))
    table = spark.createDataFrame(rows, "chrom_id long, " + FAI)

    def run(frames):
        import pandas as pd

        with open(path.removeprefix("file://"), "rb") as f:
            for frame in frames:
                out = []
                for c, name, n, offset, bases, width in frame.itertuples(index=False):
                    f.seek(offset)
                    size = n + (n - 1) // bases * (width - bases) if n else 0
                    text = f.read(size).replace(b"\n", b"").replace(b"\r", b"").decode()
                    if len(text) != n:
                        raise ValueError(f"the index does not fit the file at {name}")
                    out.append((c, name, text))
                yield pd.DataFrame(out, columns=["chrom_id", "name", "seq"])

    found = table.repartition("chrom_id").mapInPandas(run, "chrom_id long, name string, seq string")
    name = dna.cut_name("name") if cut_names else F.col("name")
    return Genome(found.select("chrom_id", name.alias("name"), dna.filter_bases("seq").alias("seq")))


def fasta_lines(chroms: DataFrame, width: int = 80) -> DataFrame:
    """(chrom_id, line_no, value) of a FASTA file."""
    lines = F.concat(F.array(F.concat(F.lit(">"), "name")), dna.wrapped("seq", width))
    return chroms.select("chrom_id", F.posexplode(lines).alias("line_no", "value"))


def write_fasta(genome: Genome, prefix: str, width: int = 80, compress: str | None = None, overwrite: bool = False, single_file: bool = True) -> str:
    """<prefix>.fa, or <prefix>.fa.gz, in the order of chromosomes."""
    return write_lines(fasta_lines(genome.chroms, width), ["chrom_id", "line_no"], f"{prefix}.fa", compress, overwrite, single_file)


def write_hap_fasta(haplotypes, prefix: str, width: int = 80, compress: str | None = None, overwrite: bool = False) -> list[str]:
    """<prefix>__<hap>.fa for every haplotype."""
    names = haplotypes.genome.chroms.select("chrom_id", "name")
    seqs = haplotypes.sequences().join(names, "chrom_id")
    out = []
    for r in haplotypes.haps.orderBy("hap_id").collect():
        lines = fasta_lines(seqs.where(F.col("hap_id") == r["hap_id"]), width)
        out.append(write_lines(lines, ["chrom_id", "line_no"], f"{prefix}__{r['name']}.fa", compress, overwrite))
    return out
