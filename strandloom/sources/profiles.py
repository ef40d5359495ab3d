"""Read quality profiles in the text format of the ART simulator, and which one suits a read length."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# System, read length, mates.
SYSTEMS = [
    ("Genome Analyzer I", "GA1", 36, 2), ("Genome Analyzer I", "GA1", 44, 2), ("Genome Analyzer II", "GA2", 50, 2),
    ("MiniSeq TruSeq", "MinS", 50, 1), ("Genome Analyzer II", "GA2", 75, 2), ("NextSeq 500 v2", "NS50", 75, 2),
    ("HiSeq 1000", "HS10", 100, 2), ("HiSeq 2000", "HS20", 100, 2), ("HiSeq 2500", "HS25", 125, 2), ("HiSeq 2500", "HS25", 150, 2),
    ("HiSeqX v2.5 PCR free", "HSXn", 150, 2), ("HiSeqX v2.5 TruSeq", "HSXt", 150, 2), ("MiSeq v1", "MSv1", 250, 2), ("MiSeq v3", "MSv3", 250, 2),
]
DEFAULTS = [(44, "GA1"), (75, "GA2"), (100, "HS20"), (150, "HS25"), (250, "MSv1")]


@dataclass(frozen=True)
class Profile:
    """Per base (T, C, A, G) and position: qualities and their cumulative shares."""

    quals: list[list[np.ndarray]]
    cumulative: list[list[np.ndarray]]

    @property
    def length(self) -> int:
        return len(self.quals[0])


def systems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYSTEMS, "name string, abbrev string, read_length int, mates int")


def default_system(lengths: DataFrame, column: str = "read_length") -> DataFrame:
    """Adds seq_sys, the default system of a read length."""
    out: Column = F.lit(None).cast("string")
    for most, name in reversed(DEFAULTS):
        out = F.when(F.col(column) <= most, name).otherwise(out)
    return lengths.withColumn("seq_sys", out)


def find_system(spark: SparkSession, read_length: int, seq_sys: str | None = None, mate: int = 1) -> tuple[str, int]:
    """(abbreviation, length) of the shortest profile of a system that is long enough."""
    if seq_sys is None:
        seq_sys = next((name for most, name in DEFAULTS if read_length <= most), None)
    s = systems(spark).where((F.col("abbrev") == seq_sys) | (F.col("name") == seq_sys)).where((F.col("mates") >= mate) & (F.col("read_length") >= read_length))
    row = s.orderBy("read_length").limit(1).first()
    if row is None:
        raise ValueError(f"no profile of {seq_sys} has reads of {read_length} bases for mate {mate}")
    return row["abbrev"], row["read_length"]


def frame(spark: SparkSession, path: str) -> DataFrame:
    """(nt, pos, quals, counts) from a profile file: pairs of lines, qualities and cumulative counts."""
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    parts = lines.where(F.col("line").rlike("^[TCAG]\t")).select("line_no", F.split("line", "\t").alias("x"))
    parts = parts.select("line_no", F.element_at("x", 1).alias("nt"), F.element_at("x", 2).cast("int").alias("pos"), F.expr("transform(filter(slice(x, 3, size(x)), v -> v <> ''), v -> cast(v AS double))").alias("v"))
    w = Window.partitionBy("nt", "pos").orderBy("line_no")
    both = parts.withColumns({"r": F.row_number().over(w), "next": F.lead("v").over(w), "n": F.count("*").over(Window.partitionBy("nt", "pos"))})
    return both.where("r = 1").select("nt", "pos", F.transform("v", lambda q: q.cast("int")).alias("quals"), "next", "n").select("nt", "pos", "quals", F.col("next").alias("counts"), "n")


def read_profile(spark: SparkSession, path: str, read_length: int) -> Profile:
    rows = {(r["nt"], r["pos"]): r for r in frame(spark, path).where(F.col("pos") < read_length).collect()}
    quals, cumulative = [], []
    for nt in "TCAG":
        q, c = [], []
        for p in range(read_length):
            r = rows.get((nt, p))
            if r is None or r["n"] != 2 or r["counts"] is None or len(r["counts"]) != len(r["quals"]) or np.any(np.diff(r["counts"]) < 0) or r["counts"][-1] <= 0:
                raise ValueError(f"the profile has no proper pair of lines for {nt} at {p}")
            q.append(np.array(r["quals"]))
            c.append(np.array(r["counts"]) / r["counts"][-1])
        quals.append(q)
        cumulative.append(c)
    return Profile(quals, cumulative)


def falling(read_length: int, best: int = 38, worst: int = 20, spread: int = 4) -> Profile:
    """A synthetic profile for when no file is given: qualities fall along the read."""
    quals, cumulative = [], []
    for p in range(read_length):
        mid = round(best - (best - worst) * (p / max(read_length - 1, 1)) ** 2)
        q = np.arange(max(2, mid - spread), mid + spread + 1)
        w = np.exp(-((q - mid) ** 2) / (spread or 1))
        quals.append(q)
        cumulative.append(np.cumsum(w) / w.sum())
    return Profile([quals] * 4, [cumulative] * 4)
