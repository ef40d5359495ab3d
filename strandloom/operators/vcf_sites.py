"""VCF sites from mutations: overlapping intervals over all haplotypes, alleles and genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mutations import applied


def intervals(mutations: DataFrame) -> DataFrame:
    """Adds a and b, the closed reference interval of a mutation.

    A deletion takes the base before it along, or, at the start of a chromosome, the one after it.
    """
    is_del = F.length("alt") < F.col("ref_len")
    a = F.when(is_del & (F.col("old_pos") > 0), F.col("old_pos") - 1).otherwise(F.col("old_pos"))
    b = F.when(is_del & (F.col("old_pos") == 0), F.col("ref_len").cast("long")).otherwise(F.col("old_pos") + F.col("ref_len") - 1)
    return mutations.withColumns({"a": a, "b": b})


def islands(mutations: DataFrame) -> DataFrame:
    """Adds site (number within the chromosome), start and end: runs of intervals that overlap, whatever the haplotype.

    Distinct intervals alone are ordered per chromosome; mutations join them back, so a
    chromosome's window holds few and narrow rows however many haplotypes there are.
    """
    m = intervals(mutations)
    spans = m.groupBy("chrom_id", "a").agg(F.max("b").alias("b"))
    w = Window.partitionBy("chrom_id").orderBy("a")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(before.isNull() | (F.col("a") > before), 1).otherwise(0))
    spans = spans.withColumn("site", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edges = Window.partitionBy("chrom_id", "site")
    spans = spans.select("chrom_id", "a", "site", F.min("a").over(edges).alias("start"), F.max("b").over(edges).alias("end"))
    return m.join(spans, ["chrom_id", "a"])


def alleles(chroms: DataFrame, mutations: DataFrame) -> DataFrame:
    """(chrom_id, site, start, ref, hap_id, alt) of every haplotype that has mutations in a site."""
    sites = islands(mutations).groupBy("chrom_id", "site", "start", "end", "hap_id").agg(F.array_sort(F.collect_list(F.struct("old_pos", "ref_len", "alt"))).alias("ms"))
    ref = F.substring(F.col("seq"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start") + 1).cast("int"))
    rows = sites.join(chroms.select("chrom_id", "seq"), "chrom_id").withColumn("ref", ref)
    return rows.select("chrom_id", "site", "start", "ref", "hap_id", applied(F.col("ref"), F.col("ms"), F.col("start")).alias("alt"))


def genotypes(chroms: DataFrame, mutations: DataFrame, haps: DataFrame) -> DataFrame:
    """(chrom_id, pos, ref, alts array, gts array): one row per site that differs from the reference.

    pos counts from 1; alleles are numbered in the order of the first haplotype that has
    them; gts are in the order of hap_id, 0 for the reference.
    """
    differ = alleles(chroms, mutations).where("alt <> ref")
    # windows, as a join would make all alleles a second time; a site has one row for each haplotype at most
    first = differ.withColumn("first", F.min("hap_id").over(Window.partitionBy("chrom_id", "site", "alt")))
    numbered = first.withColumn("n", F.dense_rank().over(Window.partitionBy("chrom_id", "site").orderBy("first")))
    rows = numbered.groupBy("chrom_id", "site").agg(
        F.min("start").alias("start"),
        F.min("ref").alias("ref"),
        F.transform(F.array_sort(F.collect_set(F.struct("n", "alt"))), lambda x: x["alt"]).alias("alts"),
        F.map_from_entries(F.collect_list(F.struct("hap_id", "n"))).alias("by_hap"),
    )
    every = haps.agg(F.array_sort(F.collect_list("hap_id")).alias("haps"))
    rows = rows.join(F.broadcast(every))  # one row
    gts = F.transform("haps", lambda h: F.coalesce(F.element_at("by_hap", h), F.lit(0)))
    return rows.select("chrom_id", (F.col("start") + 1).alias("pos"), "ref", "alts", gts.alias("gts"))


def sample_genotypes(sites: DataFrame, samples: list[list[int]]) -> DataFrame:
    """Replaces gts by strings such as 0|1, one per sample; samples hold places of haplotypes, counted from 1."""
    ploidy = {len(s) for s in samples}
    used = [h for s in samples for h in s]
    if len(ploidy) != 1 or len(set(used)) != len(used) or min(used) < 1:
        raise ValueError("samples must be equally long lists of different haplotypes, counted from 1")
    strings = [F.concat_ws("|", *[F.get("gts", F.lit(h - 1)).cast("string") for h in s]) for s in samples]
    return sites.withColumn("gts", F.array(*strings))


def from_records(records: DataFrame) -> DataFrame:
    """Mutations of (hap_id, chrom_id, pos, ref, alt) rows; pos counts from 1, a null alt is the reference.

    Bases that differ are substitutions; what a longer alt has more is inserted at the last
    base of ref, what a shorter one lacks is deleted after it.
    """
    r = records.where(F.col("alt").isNotNull() & (F.col("alt") != F.col("ref")))
    nr, na = F.length("ref"), F.length("alt")
    # the last base carries an insertion, whether or not it differs
    same = F.when(na > nr, nr - 1).otherwise(F.least(nr, na))
    subs = r.where(same > 0).select("*", F.explode(F.sequence(F.lit(0), same - 1)).alias("i"))
    x, y = (F.substring(F.col(c), F.col("i") + 1, F.lit(1)) for c in ("ref", "alt"))
    p0 = F.col("pos") - 1
    subs = subs.where(x != y).select("hap_id", "chrom_id", (p0 + F.col("i")).alias("old_pos"), F.lit(1).alias("ref_len"), y.alias("alt"))
    ins = r.where(na > nr).select("hap_id", "chrom_id", (p0 + nr - 1).alias("old_pos"), F.lit(1).alias("ref_len"), F.substring(F.col("alt"), nr, na - nr + 1).alias("alt"))
    dels = r.where(na < nr).select("hap_id", "chrom_id", (p0 + na).alias("old_pos"), (nr - na).alias("ref_len"), F.lit("").alias("alt"))
    out = subs.unionByName(ins).unionByName(dels)
    return out.select(F.col("hap_id").cast("int").alias("hap_id"), F.col("chrom_id").cast("long").alias("chrom_id"), F.col("old_pos").cast("long").alias("old_pos"), F.col("ref_len").cast("int").alias("ref_len"), "alt")
