"""Haplotype sets: how they are made, and what can be done with them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna, rng
from ..plans import models
from ..plans.checks import distinct, number, whole
from ..sources.ms import RegionTree
from ..sources.newick import Tree, coalescent
from . import mutations as M
from . import vcf_sites as V
from .evolve import evolve
from .genome import Genome


@dataclass(frozen=True)
class Theta:
    """A random coalescent tree whose length gives this population mutation rate."""

    theta: float
    n_haps: int


@dataclass(frozen=True)
class Phylo:
    """One tree for all chromosomes, or one for each."""

    trees: Sequence[Tree]


@dataclass(frozen=True)
class GeneTrees:
    """Trees of the regions of every chromosome."""

    chroms: Sequence[Sequence[RegionTree]]


@dataclass(frozen=True)
class SegSites:
    """(chrom_id, site_id, pos, hap_id, allele) rows."""

    sites: DataFrame


@dataclass(frozen=True)
class Records:
    """(hap_id, chrom_id, pos, ref, alt) rows of a VCF file, and names of the haplotypes."""

    records: DataFrame
    names: Sequence[str]


@dataclass(frozen=True)
class Haplotypes:
    """A genome, haplotypes (hap_id, name) and their mutations; immutable."""

    genome: Genome
    haps: DataFrame
    mutations: DataFrame

    @staticmethod
    def empty(genome: Genome, names: Sequence[str] | int) -> Haplotypes:
        spark = genome.chroms.sparkSession
        names = [f"hap{i}" for i in range(names)] if isinstance(names, int) else list(names)
        return Haplotypes(genome, spark.createDataFrame(list(enumerate(names)), "hap_id int, name string"), spark.createDataFrame([], M.SCHEMA))

    def n_haps(self) -> int:
        return self.haps.count()

    def names(self) -> list[str]:
        return [r["name"] for r in self.haps.orderBy("hap_id").collect()]

    def sizes(self) -> DataFrame:
        return M.sizes(self.genome.chroms, self.haps, self.mutations)

    def sequences(self) -> DataFrame:
        return M.materialize(self.genome.chroms, self.haps, self.mutations)

    def chrom(self, hap_id: int, chrom_id: int) -> str:
        one = Haplotypes(replace(self.genome, chroms=self.genome.chroms.where(F.col("chrom_id") == chrom_id)), self.haps.where(F.col("hap_id") == hap_id), self.mutations.where((F.col("hap_id") == hap_id) & (F.col("chrom_id") == chrom_id)))
        row = one.sequences().first()
        if row is None:
            raise ValueError("there is no such haplotype or chromosome")
        return row["seq"]

    def shares(self, bases: str = "GC", start: int | None = None, end: int | None = None) -> DataFrame:
        seq = F.col("seq") if start is None else dna.window("seq", start, end if end is not None else start)
        return self.sequences().select("hap_id", "chrom_id", dna.share(seq, bases).alias("share"))

    def spectrum(self) -> DataFrame:
        return M.spectrum(self.genome.chroms, self.mutations)

    def view_mutations(self) -> DataFrame:
        return M.with_new_pos(self.mutations)

    def genotypes(self) -> DataFrame:
        return V.genotypes(self.genome.chroms, self.mutations, self.haps)

    def edit(self, edits: DataFrame) -> Haplotypes:
        return replace(self, mutations=M.edit(self.genome.chroms, self.mutations, edits))

    def set_names(self, names: Sequence[str]) -> Haplotypes:
        old = [r["hap_id"] for r in self.haps.orderBy("hap_id").collect()]
        if len(old) != len(names):
            raise ValueError("there must be one name per haplotype")
        return replace(self, haps=self.haps.sparkSession.createDataFrame(list(zip(old, names, strict=True)), "hap_id int, name string"))

    def add(self, names: Sequence[str]) -> Haplotypes:
        have = self.names()
        distinct("names", [*have, *names])
        first = (self.haps.agg(F.max("hap_id")).first()[0] if have else -1) or 0
        new = self.haps.sparkSession.createDataFrame([(first + 1 + i if have else i, n) for i, n in enumerate(names)], "hap_id int, name string")
        return replace(self, haps=self.haps.unionByName(new))

    def remove(self, names: Sequence[str]) -> Haplotypes:
        if missing := set(distinct("names", names)) - set(self.names()):
            raise ValueError(f"no haplotype is named {min(missing)}")
        kept = self.haps.where(~F.col("name").isin(list(names)))
        return replace(self, haps=kept, mutations=self.mutations.join(F.broadcast(kept.select("hap_id")), "hap_id", "left_semi").select(*self.mutations.columns))

    def duplicate(self, names: Sequence[str], new_names: Sequence[str] | None = None) -> Haplotypes:
        """Copies of haplotypes; without names they are called <name>_dup<k>."""
        ids = {r["name"]: r["hap_id"] for r in self.haps.collect()}
        if missing := set(names) - ids.keys():
            raise ValueError(f"no haplotype is named {min(missing)}")
        spark = self.haps.sparkSession
        top, count, rows = max(ids.values()), {}, []
        for j, n in enumerate(names):
            count[n] = count.get(n, 0) + 1
            rows.append((top + 1 + j, ids[n], new_names[j] if new_names else f"{n}_dup{count[n]}"))
        distinct("names", [*ids, *(r[2] for r in rows)])
        new = spark.createDataFrame(rows, "new_id int, hap_id int, name string")
        copies = self.mutations.join(F.broadcast(new.select("new_id", "hap_id")), "hap_id").select(F.col("new_id").alias("hap_id"), "chrom_id", "old_pos", "ref_len", "alt")
        return replace(self, haps=self.haps.unionByName(new.select(F.col("new_id").alias("hap_id"), "name")), mutations=self.mutations.unionByName(copies))

    def __repr__(self) -> str:
        return f"<{self.n_haps():,} haplotypes of {self.genome.name}: {self.mutations.count():,} mutations>"


def duplicated(again: DataFrame, haps: DataFrame) -> DataFrame:
    """Names <name>_dup<k> for every row of again, k counting from 1 within a name."""
    k = F.row_number().over(Window.partitionBy("hap_id", "name").orderBy("name"))
    return again.select("hap_id", F.concat("name", F.lit("_dup"), k.cast("string")).alias("name"))


# --- segregating sites ---


def site_positions(sites: DataFrame, chroms: DataFrame) -> DataFrame:
    """0-based positions of sites, by chromosome: shares of its size if all lie in (0, 1), else whole
    numbers from 0 or from 1; of sites at one position the first stays, others are wrong."""
    size = chroms.select("chrom_id", F.length("seq").cast("long").alias("size"))
    spread = sites.groupBy("chrom_id").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.max((F.col("pos") != F.floor("pos")).cast("int")).alias("parts"))
    rows = sites.select("chrom_id", "site_id", "pos").distinct().join(size, "chrom_id").join(spread, "chrom_id")
    wrong = F.raise_error(F.concat(F.lit("positions of sites do not fit chromosome "), F.col("chrom_id").cast("string")))
    at = (
        F.when((F.col("low") > 0) & (F.col("high") < 1), F.floor(F.col("pos") * F.col("size")))
        .when((F.col("parts") == 0) & (F.col("low") >= 0) & (F.col("high") <= F.col("size") - 1), F.col("pos").cast("long"))
        .when((F.col("parts") == 0) & (F.col("low") >= 1) & (F.col("high") <= F.col("size")), F.col("pos").cast("long") - 1)
        .otherwise(wrong.cast("long"))
    )
    rows = rows.select("chrom_id", "site_id", at.cast("long").alias("pos"))
    first = Window.partitionBy("chrom_id", "pos").orderBy("site_id")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def site_mutations(chroms: DataFrame, sites: DataFrame, carriers: DataFrame, sub: models.Substitution, ins: models.Indels | None, dels: models.Indels | None, seed: int = 0) -> DataFrame:
    """One event per site by its base's weights, given to every carrier (site_id, hap_id).

    sites have 0-based pos. An event is drawn from the counter-based generator, so it is
    the same for all carriers. A deletion is cut at the next site and the chromosome's end.
    """
    ri, rd = (x.rates if x else np.zeros(0) for x in (ins, dels))
    weights = models.event_weights(sub, models.Indels(ri), models.Indels(rd))
    names = [("sub", b, 0) for b in dna.BASES] + [("ins", "", n + 1) for n in range(len(ri))] + [("del", "", n + 1) for n in range(len(rd))]
    rows = []
    for i, base in enumerate(dna.BASES):
        low = 0.0
        for (kind, to, n), w in zip(names, weights[i], strict=True):
            if w > 0:
                rows.append((base, kind, to, n, low, low + float(w)))
                low += float(w)
    spark = chroms.sparkSession
    events = spark.createDataFrame(rows, "base string, kind string, to string, n int, low double, high double")
    u = rng.uniform(seed, "ssite", "chrom_id", "pos")
    following = F.lead("pos").over(Window.partitionBy("chrom_id").orderBy("pos"))
    s = sites.withColumns({"u": u, "next": following}).join(chroms.select("chrom_id", "seq"), "chrom_id")
    s = s.withColumn("base", F.substring(F.col("seq"), F.col("pos").cast("int") + 1, F.lit(1)))
    drawn = s.join(F.broadcast(events), "base").where((F.col("u") > F.col("low")) & (F.col("u") <= F.col("high")))
    letters = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: F.substring(F.lit(dna.BASES), rng.pick(rng.uniform(seed, "inserted", F.col("chrom_id"), F.col("pos"), i), rng.cumulative(sub.pi.tolist())) + 1, F.lit(1))), "")
    alt = F.when(F.col("kind") == "sub", F.col("to")).when(F.col("kind") == "ins", F.concat("base", letters)).otherwise("")
    length = F.when(F.col("kind") == "del", F.least(F.col("n"), F.coalesce("next", F.length("seq").cast("long")) - F.col("pos"))).otherwise(1).cast("int")
    found = drawn.select("chrom_id", "site_id", F.col("pos").alias("old_pos"), length.alias("ref_len"), alt.alias("alt"))
    on = ["chrom_id", "site_id"] if "chrom_id" in carriers.columns else ["site_id"]
    return found.join(carriers, on).select("hap_id", "chrom_id", "old_pos", "ref_len", "alt")


# --- trees ---


def regions(trees: Sequence[RegionTree], size: int) -> list[tuple[int, int, Tree]]:
    """(start, end, tree) of a chromosome's regions; sizes are bases, or shares if none is above 1."""
    if len(trees) == 1:
        return [(0, size, trees[0].tree)]
    n = np.array([t.size for t in trees], float)
    if (n <= 1).all() and size > 1:
        n = np.round(n / n.sum() * size)
        kept = [(t, x) for t, x in zip(trees, n, strict=True) if x > 0]
        trees, n = [t for t, _ in kept], np.array([x for _, x in kept])
        i = 0
        while n.sum() != size:  # rounding is spread over the regions in turn
            step = 1 if n.sum() < size else -1
            if n[i % len(n)] + step > 0:
                n[i % len(n)] += step
            i += 1
    elif n.sum() != size:
        raise ValueError("the sizes of a chromosome's regions must add up to its size")
    ends = np.cumsum(n).astype(int)
    return [(int(e - x), int(e), t.tree) for e, x, t in zip(ends, n, trees, strict=True)]


def theta_tree(theta: float, n_haps: int, sub: models.Substitution, ins: models.Indels | None, dels: models.Indels | None, seed: int) -> Tree:
    """A coalescent tree of total length theta / mu x the sum of 1/i; mu counts a quarter of indels per base."""
    number("theta", theta, 0)
    tree = coalescent(whole("n_haps", n_haps, 2), rng.generator(seed, "coalescent"))
    more = 0.25 * sum(x.rates.sum() for x in (ins, dels) if x)
    mu = float(sub.pi @ (sub.rates_by_base() + more))
    if mu <= 0:
        raise ValueError("the mutation rate must be positive")
    a = sum(1 / i for i in range(1, n_haps))
    return tree.scaled(theta / mu * a / tree.total_length())


#: Mutations that a task gathers before it gives them out.
GATHERED = 50_000


def _by_trees(genome: Genome, per_chrom: dict[int, list[tuple[int, int, Tree]]] | None, one: Tree | None, tips: list[str], sub, ins, dels, epsilon: float, seed: int) -> DataFrame:
    """Each region of each chromosome is a row, and evolves in one call; regions run apart."""
    spark = genome.chroms.sparkSession
    if per_chrom is None:
        rows = genome.chroms.select("chrom_id", F.lit(0).alias("region"), F.lit(0).cast("long").alias("start"), F.col("seq"))
        trees = {None: one}
    else:
        table = [(c, i, s, e) for c, r in per_chrom.items() for i, (s, e, _) in enumerate(r)]
        spans = spark.createDataFrame(table, "chrom_id long, region int, start long, end long")
        rows = genome.chroms.join(F.broadcast(spans), "chrom_id").select("chrom_id", "region", "start", F.substring(F.col("seq"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("seq"))
        trees = {(c, i): t for c, r in per_chrom.items() for i, (_, _, t) in enumerate(r)}
    shared = spark.sparkContext.broadcast((trees, sub, ins, dels, epsilon, seed))

    def run(batches):
        import pyarrow as pa

        trees, sub, ins, dels, epsilon, seed = shared.value
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        names, tables = ["hap_id", "chrom_id", "old_pos", "ref_len", "alt"], {}

        def batch(columns):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

        out: list[list] = [[], [], [], [], []]
        for f in batches:
            for c, g, s, seq in zip(*[f.column(x).to_pylist() for x in ("chrom_id", "region", "start", "seq")], strict=True):
                tree = trees[None] if None in trees else trees[c, g]
                for h, ms in enumerate(evolve(seq, s, tree, sub, ins, dels, epsilon, (seed, "evolve", c, g), tables)):
                    if ms:
                        for column, more in zip(out, ([h] * len(ms), [c] * len(ms), *zip(*ms, strict=True)), strict=True):
                            column += more
                if len(out[0]) >= GATHERED:
                    yield batch(out)
                    out = [[], [], [], [], []]
        yield batch(out)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that small partitions are not merged: few bytes here are much work
    return rows.repartition(parts, "chrom_id", "region").mapInArrow(run, M.SCHEMA)


def create_haplotypes(genome: Genome, method: Theta | Phylo | GeneTrees | SegSites | Records | None, sub: models.Substitution | None = None, ins: models.Indels | None = None, dels: models.Indels | None = None, epsilon: float = 0.03, seed: int = 0) -> Haplotypes:
    """Haplotypes by one of the methods. All but Records need a model of substitutions or indels.

    Random methods give the same mutations for a seed however the data are split.
    """
    spark: SparkSession = genome.chroms.sparkSession
    if method is None:
        return Haplotypes.empty(genome, 1)
    if isinstance(method, Records):
        names = list(method.names)
        haps = spark.createDataFrame(list(enumerate(names)), "hap_id int, name string")
        return Haplotypes(genome, haps, V.from_records(method.records))
    if sub is None and ins is None and dels is None:
        raise ValueError("give a model of substitutions, insertions or deletions")
    sub = sub or models.jc69(0.0, mu=None)
    number("epsilon", epsilon, 0, 1)
    if isinstance(method, SegSites):
        sites = site_positions(method.sites, genome.chroms)
        carriers = method.sites.where("allele = 1").select("chrom_id", "site_id", "hap_id")
        n = (method.sites.agg(F.max("hap_id")).first()[0] or 0) + 1
        base = Haplotypes.empty(genome, n)
        return replace(base, mutations=site_mutations(genome.chroms, sites, carriers, sub, ins, dels, seed))
    if isinstance(method, Theta):
        method = Phylo([theta_tree(method.theta, method.n_haps, sub, ins, dels, seed)])
    if isinstance(method, Phylo) and len(method.trees) == 1:
        tree = method.trees[0]
        found = _by_trees(genome, None, tree, tree.tips, sub, ins, dels, epsilon, seed)
        tips = tree.tips
    else:
        ids = [(r["chrom_id"], r["size"]) for r in genome.sizes().orderBy("chrom_id").collect()]
        lists = [[RegionTree(None, t)] for t in method.trees] if isinstance(method, Phylo) else method.chroms
        if len(lists) != len(ids):
            raise ValueError("there must be trees for every chromosome")
        tips = list(lists[0][0].tree.tips)
        per = {c: [(s, e, t.ordered_as(tips)) for s, e, t in regions(x, size)] for (c, size), x in zip(ids, lists, strict=True)}
        found = _by_trees(genome, per, None, tips, sub, ins, dels, epsilon, seed)
    return Haplotypes(genome, spark.createDataFrame(list(enumerate(tips)), "hap_id int, name string"), found)
