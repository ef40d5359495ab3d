"""VCF files."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import vcf_sites as V
from ..operators.genome import Genome
from ..operators.haplotypes import Records
from .files import write_lines

#: The constant qualities and the header.
QUALITY = "441453"


def header(genome: Genome, samples: Sequence[str]) -> list[str]:
    contigs = genome.sizes().orderBy("chrom_id").collect()
    return [
        "##fileformat=VCFv4.3",
        f"##fileDate={datetime.date.today():%Y%m%d}",
        "##source=strandloom",
        *[f"##contig=<ID={r['name']},length={r['size']}>" for r in contigs],
        "##phasing=full",
        '##INFO=<ID=NS,Number=1,Type=Integer,Description="Number of Samples With Data">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
        '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype Quality">',
        "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]),
    ]


def data_lines(genome: Genome, sites: DataFrame) -> DataFrame:
    """(chrom_id, pos, value) of sites whose gts are one string per sample."""
    calls = F.array_join(F.transform("gts", lambda g: F.concat(g.cast("string"), F.lit(f":{QUALITY}"))), "\t")
    named = sites.join(genome.chroms.select("chrom_id", "name"), "chrom_id")
    value = F.concat_ws("\t", "name", F.col("pos").cast("string"), F.lit("."), "ref", F.array_join("alts", ","), F.lit(QUALITY), F.lit("PASS"), F.concat(F.lit("NS="), F.size("gts").cast("string")), F.lit("GT:GQ"), calls)
    return named.select("chrom_id", "pos", value.alias("value"))


def write_vcf(haplotypes, prefix: str, samples: list[list[int]] | None = None, compress: bool = False, overwrite: bool = False) -> str:
    """<prefix>.vcf, or a blocked gzip; samples are rows of haplotypes, counted from 1."""
    names = haplotypes.names()
    samples = samples or [[i + 1] for i in range(len(names))]
    if max(h for s in samples for h in s) > len(names):
        raise ValueError("samples name a haplotype that there is not")
    sites = V.sample_genotypes(haplotypes.genotypes(), samples)
    top = header(haplotypes.genome, ["__".join(names[h - 1] for h in s) for s in samples])
    spark = haplotypes.haps.sparkSession
    head = spark.createDataFrame([(-1, i, x) for i, x in enumerate(top)], "chrom_id long, pos long, value string")
    lines = head.unionByName(data_lines(haplotypes.genome, sites))
    return write_lines(lines, ["chrom_id", "pos"], f"{prefix}.vcf", "bgzip" if compress else None, overwrite)


def read_vcf(spark: SparkSession, path: str, genome: Genome) -> Records:
    """Haplotypes of a plain or gzipped VCF; phased or not makes no difference.

    Contigs are matched to chromosomes by name. Records without GT are left out, missing
    alleles are the reference; symbolic alleles, changing ploidy, positions out of order
    and positions that overlap within a chromosome's haplotype are errors.
    """
    text = spark.read.text(path)
    # lines keep their order within a block of a file
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    lines = text.select(F.regexp_replace("value", "\r$", "").alias("value"), place.alias("place"))
    top = lines.where(F.col("value").startswith("#CHROM")).first()
    if top is None:
        raise ValueError("the file has no #CHROM line")
    samples = top["value"].split("\t")[9:]
    x = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        "place",
        x[0].alias("name"), x[1].cast("long").alias("pos"), x[3].alias("ref"), F.split(x[4], ",").alias("alts"), F.array_position(F.split(x[8], ":"), "GT").cast("int").alias("at"), F.slice(x, 10, len(samples)).alias("calls"))
    rows = rows.where("at > 0").withColumn("gts", F.transform("calls", lambda c: F.split(F.get(F.split(c, ":"), F.col("at") - 1), "[|/]")))
    ploidies = [r[0] for r in rows.select(F.explode("gts").alias("g")).select(F.size("g").alias("p")).distinct().collect()]
    if len(ploidies) > 1:
        raise ValueError("ploidy must be the same in all records")
    ploidy = ploidies[0] if ploidies else 1
    if rows.where(F.exists("alts", lambda a: ~a.rlike("^[TCAGNtcagn.]+$"))).limit(1).count():
        raise ValueError("symbolic alleles cannot be read")
    along = Window.partitionBy("name").orderBy("place")
    if rows.select("name", "pos", F.lag("pos").over(along).alias("before")).where("before > pos").limit(1).count():
        raise ValueError("records of a contig are not in order of position")
    known = genome.chroms.select("name", "chrom_id")
    if rows.join(known, "name", "left_anti").limit(1).count():
        raise ValueError("a contig is not a chromosome of the genome")
    calls = rows.join(known, "name").select("chrom_id", "pos", "ref", "alts", F.posexplode(F.flatten("gts")).alias("hap_id", "g"))
    n = F.expr("try_cast(g AS int)")
    found = calls.select("hap_id", "chrom_id", "pos", F.upper("ref").alias("ref"), F.when(n > 0, F.upper(F.get("alts", n - 1))).alias("alt")).where("alt IS NOT NULL")
    w = Window.partitionBy("hap_id", "chrom_id").orderBy("pos")
    if found.withColumn("end", F.lag(F.col("pos") + F.length("ref") - 1).over(w)).where("end >= pos").limit(1).count():
        raise ValueError("records of a haplotype overlap")
    return Records(found, hap_names(samples, ploidy))


def hap_names(samples: Sequence[str], ploidy: int) -> list[str]:
    """Sample names; for several haplotypes each, the parts of names joined by __, or numbered."""
    if ploidy == 1:
        return list(samples)
    if all(s.count("__") == ploidy - 1 for s in samples):
        return [p for s in samples for p in s.split("__")]
    return [f"{s}_{i + 1}" for s in samples for i in range(ploidy)]
