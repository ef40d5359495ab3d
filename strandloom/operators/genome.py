"""Genomes: ordered, named sequences as a DataFrame, and operations that return new genomes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna, rng
from ..plans.checks import distinct, number, numbers_of, whole

COLUMNS = ("chrom_id", "name", "seq")


@dataclass(frozen=True)
class Genome:
    """chrom_id (order), name and seq of every chromosome; immutable, so an edit gives a new genome."""

    chroms: DataFrame
    name: str = "REF"

    # --- making ---

    @staticmethod
    def of(spark: SparkSession, sequences: Sequence[str], names: Sequence[str] | None = None) -> Genome:
        names = [f"chrom{i}" for i in range(len(sequences))] if names is None else list(names)
        if len(names) != len(sequences):
            raise ValueError("names and sequences must be equally many")
        return Genome(spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(zip(names, sequences, strict=True))], "chrom_id long, name string, seq string"))

    @staticmethod
    def simulate(spark: SparkSession, n_chroms: int, len_mean: float, len_sd: float = 0, pi: Sequence[float] = (0.25,) * 4, seed: int = 0) -> Genome:
        """Chromosomes with Gamma lengths and independent bases; each is made in one task from its own stream."""
        n, mean, sd = whole("n_chroms", n_chroms, 1), number("len_mean", len_mean, 1), number("len_sd", len_sd, 0)
        w = numbers_of("pi", pi, 4)

        def run(frames):
            import numpy as np
            import pandas as pd

            p = np.array(w) / sum(w)
            letters = np.frombuffer(dna.BASES.encode(), np.uint8)
            for f in frames:
                for i in f["id"]:
                    g = rng.generator(seed, "genome", i)
                    size = max(1, int(g.gamma((mean / sd) ** 2, sd**2 / mean) if sd else mean))
                    yield pd.DataFrame({"chrom_id": [i], "name": [f"chrom{i}"], "seq": [letters[g.choice(4, size, p=p)].tobytes().decode()]})

        return Genome(spark.range(n).mapInPandas(run, "chrom_id long, name string, seq string"))

    # --- views ---

    def n_chroms(self) -> int:
        return self.chroms.count()

    def sizes(self) -> DataFrame:
        return self.chroms.select("chrom_id", "name", dna.size("seq").alias("size"))

    def total_size(self) -> int:
        return self.chroms.agg(F.sum(dna.size("seq"))).first()[0] or 0

    def names(self) -> list[str]:
        return [r[0] for r in self.chroms.orderBy("chrom_id").select("name").collect()]

    def chrom(self, chrom_id: int) -> str:
        row = self.chroms.where(F.col("chrom_id") == chrom_id).select("seq").first()
        if row is None:
            raise ValueError(f"there is no chromosome {chrom_id}")
        return row[0]

    def shares(self, bases: str = "GC", start: int | None = None, end: int | None = None) -> DataFrame:
        """Share of bases per chromosome, or in positions start to end (from 1, both included)."""
        if start is not None and not 1 <= start <= (end if end is not None else start):
            raise ValueError("start must be at least 1 and at most end")
        seq = F.col("seq") if start is None else dna.window("seq", start, end if end is not None else start)
        return self.chroms.select("chrom_id", "name", dna.share(seq, bases).alias("share"))

    def __repr__(self) -> str:
        rows = self.sizes().orderBy("chrom_id").limit(11).collect()
        lines = [f"  {r['name'][:30]:<30} {r['size']:>15,}" for r in rows[:10]] + ["  ..."] * (len(rows) > 10)
        return f"<genome {self.name}: {self.n_chroms():,} chromosomes, {self.total_size():,} bases>\n" + "\n".join(lines)

    # --- names ---

    def set_names(self, names: Sequence[str] | DataFrame) -> Genome:
        """New names in order, or a table (chrom_id, name) with one row for every chromosome."""
        if isinstance(names, DataFrame):
            joined = self.chroms.drop("name").join(names.select("chrom_id", "name"), "chrom_id", "left")
            missing = F.raise_error(F.concat(F.lit("no name for chromosome "), F.col("chrom_id").cast("string")))
            return Genome(joined.withColumn("name", F.coalesce("name", missing.cast("string"))).select(*COLUMNS), self.name)
        spark = self.chroms.sparkSession
        if len(names) != self.n_chroms():
            raise ValueError("there must be one name per chromosome")
        order = self.chroms.select("chrom_id", (F.row_number().over(Window.orderBy("chrom_id")) - 1).alias("at"))
        new = spark.createDataFrame(list(enumerate(names)), "at long, name string")
        return Genome(self.chroms.drop("name").join(order.join(new, "at"), "chrom_id").select(*COLUMNS), self.name)

    def clean_names(self) -> Genome:
        return Genome(self.chroms.withColumn("name", dna.clean_name("name")), self.name)

    # --- selections ---

    def filter_size(self, least: int) -> Genome:
        """Chromosomes of at least that size, largest first."""
        return Genome(by_size(filter_size(self.chroms, whole("least", least, 1))), self.name)

    def filter_share(self, share: float) -> Genome:
        """The fewest largest chromosomes that make up that share of all bases, largest first."""
        if not 0 < number("share", share) < 1:
            raise ValueError("share must be between 0 and 1")
        return Genome(by_size(filter_share(self.chroms, share)), self.name)

    def remove(self, names: Sequence[str] | DataFrame) -> Genome:
        """Without the named chromosomes; names may be a table with a column of that name, of any size."""
        if isinstance(names, DataFrame):
            gone = names.select("name").distinct()
            if unknown := gone.join(self.chroms.select("name"), "name", "left_anti").first():
                raise ValueError(f"no chromosome is named {unknown['name']}")
            return Genome(self.chroms.join(gone, "name", "left_anti").select(*COLUMNS), self.name)
        self._known(distinct("names", names))
        return Genome(self.chroms.where(~F.col("name").isin(list(names))), self.name)

    def next_number(self) -> DataFrame:
        """One row: the number after the largest that ends a name, or else the number of chromosomes; and the last id."""
        top = F.max(F.expr("try_cast(regexp_extract(name, '([0-9]+)$', 1) AS bigint)"))
        return self.chroms.agg(F.coalesce(top + 1, F.count("*")).alias("next_number"), F.max("chrom_id").alias("last"))

    def add(self, sequences: Sequence[str] | DataFrame, names: Sequence[str] | None = None) -> Genome:
        """More chromosomes at the end; without names they are numbered on from the largest number in use.

        A table (at, name, seq) adds chromosomes of any number, in the order of at, which
        counts from 0.
        """
        if isinstance(sequences, DataFrame):
            if sequences.join(self.chroms.select("name"), "name", "left_semi").limit(1).count():
                raise ValueError("a new name is in use")
            last = self.next_number().select(F.coalesce("last", F.lit(-1)).alias("last"))
            more = sequences.join(F.broadcast(last)).select((F.col("last") + 1 + F.col("at")).alias("chrom_id"), "name", "seq")
            return Genome(self.chroms.unionByName(more), self.name)
        spark = self.chroms.sparkSession
        row = self.next_number().first()
        first = row["next_number"]
        names = [f"chrom{first + i}" for i in range(len(sequences))] if names is None else distinct("names", names)
        if len(names) != len(sequences):
            raise ValueError("names and sequences must be equally many")
        if self.chroms.where(F.col("name").isin(names)).limit(1).count():
            raise ValueError("a new name is in use")
        start = (row["last"] if row["last"] is not None else -1) + 1
        more = spark.createDataFrame([(start + i, n, s) for i, (n, s) in enumerate(zip(names, sequences, strict=True))], "chrom_id long, name string, seq string")
        return Genome(self.chroms.unionByName(more), self.name)

    def merge(self, names: Sequence[str]) -> Genome:
        """The named chromosomes as one, in the order given, at the place of the first named."""
        self._known(distinct("names", names))
        return Genome(merge_named(self.chroms, list(names)), self.name)

    def merge_all(self, seed: int = 0) -> Genome:
        return Genome(merge_all(self.chroms, seed), self.name)

    def replace_ns(self, pi: Sequence[float], seed: int = 0) -> Genome:
        return Genome(self.chroms.withColumn("seq", replace_ns("seq", "chrom_id", pi, seed)), self.name)

    def _known(self, names: Sequence[str]) -> None:
        found = {r[0] for r in self.chroms.where(F.col("name").isin(list(names))).select("name").collect()}
        if missing := [n for n in names if n not in found]:
            raise ValueError(f"no chromosome is named {missing[0]}")


def by_size(chroms: DataFrame) -> DataFrame:
    """Renumbered by size, largest first; ties by the old number."""
    order = chroms.select("chrom_id", (F.row_number().over(Window.orderBy(F.desc(F.length("seq")), "chrom_id")) - 1).cast("long").alias("new_id"))
    return chroms.join(order, "chrom_id").select(F.col("new_id").alias("chrom_id"), "name", "seq")


def filter_size(chroms: DataFrame, least: int) -> DataFrame:
    return chroms.where(F.length("seq") >= least)


def filter_share(chroms: DataFrame, share: float) -> DataFrame:
    """Only sizes are ordered in one place; sequences come back by a join."""
    sizes = chroms.select("chrom_id", dna.size("seq").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    run = sizes.withColumn("upto", F.sum("size").over(Window.orderBy(F.desc("size"), "chrom_id").rowsBetween(Window.unboundedPreceding, 0)))
    kept = run.join(F.broadcast(total)).where(F.col("upto") - F.col("size") < F.col("total") * share).select("chrom_id")
    return chroms.join(kept, "chrom_id", "left_semi")


def merge_named(chroms: DataFrame, names: list[str]) -> DataFrame:
    at = F.array_position(F.array(*map(F.lit, names)), F.col("name"))
    chosen = chroms.withColumn("at", at).where("at > 0")
    one = chosen.agg(F.min_by("chrom_id", "at").alias("chrom_id"), F.concat_ws("__", F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"])).alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    return chroms.where(~F.col("name").isin(names)).unionByName(one.where("chrom_id IS NOT NULL").select(*COLUMNS))


def merge_all(chroms: DataFrame, seed: int = 0) -> DataFrame:
    """All chromosomes as one, in an order drawn from the seed; one sequence must fit in one row."""
    u = rng.uniform(seed, "merge", "chrom_id")
    rows = F.array_sort(F.collect_list(F.struct(u.alias("u"), F.col("chrom_id"), F.col("seq"))))
    return chroms.agg(F.lit(0).cast("long").alias("chrom_id"), F.lit("MERGE").alias("name"), F.array_join(F.transform(rows, lambda x: x["seq"]), "").alias("seq"))


def replace_ns(seq: str, key: str, pi: Sequence[float], seed: int = 0) -> Column:
    """Each N becomes a base drawn by the weights, from the chromosome, its position and the seed."""
    c = rng.cumulative(numbers_of("pi", pi, 4))
    chars = F.split(F.col(seq), "")
    drawn = F.transform(chars, lambda x, i: F.when(x != "N", x).otherwise(F.substring(F.lit(dna.BASES), rng.pick(rng.uniform(seed, "n", F.col(key), i), c) + 1, F.lit(1))))
    return F.when(F.instr(F.col(seq), "N") > 0, F.array_join(drawn, "")).otherwise(F.col(seq))


def simulated_bases(chroms: DataFrame, pi: Sequence[float], seed: int = 0) -> DataFrame:
    """(chrom_id, seq) of chroms' chrom_id and size, base by base from the counter-based generator, within the JVM."""
    c = rng.cumulative(numbers_of("pi", pi, 4))
    # each number is drawn by itself first, as pick uses it up to three times
    drawn = F.transform(F.sequence(F.lit(1), F.col("size").cast("int")), lambda i: rng.uniform(seed, "base", F.col("chrom_id"), i))
    base = F.transform(drawn, lambda u: F.substring(F.lit(dna.BASES), rng.pick(u, c) + 1, F.lit(1)))
    # a number of partitions of its own: few bytes here are much work, and a small file is one task
    parts = int(chroms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chroms.repartition(parts, "chrom_id").select("chrom_id", F.when(F.col("size") > 0, F.array_join(base, "")).otherwise("").alias("seq"))


def windows(chroms: DataFrame, width: int) -> DataFrame:
    """(chrom_id, start, seq) of consecutive windows, the last one shorter; starts count from 1."""
    n = F.ceil(F.length("seq") / width).cast("int")
    return chroms.where(F.length("seq") > 0).select("chrom_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("w"), "seq").select("chrom_id", (F.col("w") * width + 1).cast("long").alias("start"), F.substring(F.col("seq"), F.col("w") * width + 1, F.lit(width)).alias("seq"))
