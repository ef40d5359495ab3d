"""Queries use every row of their tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom import queries
from strandloom.operators import mutations as M
from strandloom.operators.reads import CHUNK, allocate

DIR = "/root/testdata/sf0.001"


def test_reads_from_all_documents(spark):
    """Each event gives one read, and every document is read from, however short."""
    docs = {r["chrom_id"]: r["seq"] for r in queries.chroms(spark, DIR).collect()}
    n_events = spark.read.parquet(f"{DIR}/events.parquet").count()
    rows = queries.read_allocation_all(spark, DIR).collect()
    assert sum(r["n_reads"] for r in rows) == n_events and {r["chrom_id"] for r in rows} == set(docs)
    fragments = queries.read_fragments_all(spark, DIR).collect()
    assert len(fragments) == n_events and any(len(s) < 150 for s in docs.values())
    for r in fragments:
        seq = docs[r["event_id"] % len(docs)]
        assert r["fragment"] == seq[r["start"] : r["start"] + 150].ljust(150, "N") and (len(seq) >= r["start"] + 150 or r["start"] == 0)
    mates = queries.mate_geometry_all(spark, DIR).collect()
    assert len(mates) == 2 * n_events and all(len(r["read"]) == 100 for r in mates)
    assert queries.fastq_records_all(spark, DIR).count() == 2 * n_events


def test_edit_fold_equals_plain_edits(spark, tmp_path):
    """Every order line edits plain strings, of short, emptied and empty chromosomes too."""
    rng = np.random.default_rng(3)
    seqs = ["", "T", "TCA", "GATTACA", "".join(rng.choice(list("TCAG"), 30)), "".join(rng.choice(list("TCAGN"), 450)), "".join(rng.choice(list("TCAG"), 3000))]
    spark.createDataFrame([(i, s, "en", "s", len(s)) for i, s in enumerate(seqs)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    lines = [(o, int(rng.integers(0, 1000)), int(rng.integers(0, 1000)), k, float(rng.integers(1, 51)), str(rng.choice(["A", "N", "R", "R"]))) for o in range(1, 150) for k in range(1, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    g, m = queries._both(spark, str(tmp_path))
    want = {(r["hap_id"], r["chrom_id"]): r["seq"] for r in M.materialize(g, queries.haps(spark), m).collect()}
    emptied = set()
    for o, part, supp, number, _, flag in sorted(lines, key=lambda x: x[0] * 8 + x[3]):
        at = (supp % queries.HAPS, part % len(seqs))
        s = want[at]
        if not seqs[at[1]]:
            continue
        p = (o * 104729 + number * 7919) % max(len(s), 1)
        if flag == "N":
            s = s[: p + 1] + "ACA" + s[p + 1 :]
        elif s:
            s = s[:p] + ("G" + s[p + 1 :] if flag == "A" else s[p + 2 :])
        want[at] = s
        emptied |= set() if s else {at}
    edited = queries.edit_fold(spark, str(tmp_path)).persist()
    got = {(r["hap_id"], r["chrom_id"]): r["seq"] for r in M.materialize(g, queries.haps(spark), edited).collect()}
    assert got == want and emptied
    assert edited.where("chrom_id = 6 AND old_pos > 1000").count() > 0
    edited.unpersist()


def test_all_species(spark):
    assert queries.evo_rates_theta_all(spark, DIR).where("theta IS NOT NULL").count() == 15


def test_simulation_uses_all_documents(spark):
    """A pair and a long read for every event, from documents of any length; mutations on all that have room for some."""
    sizes = {r["name"]: len(r["seq"]) for r in queries._bases(spark, DIR).chroms.collect()}
    n_events = spark.read.parquet(f"{DIR}/events.parquet").count()
    pairs = queries.illumina_reads(spark, DIR).groupBy("chrom", "chunk", "n").agg(F.count("*").alias("k"), F.countDistinct("strand").alias("strands"), F.max("start").alias("start")).collect()
    assert len(pairs) == n_events and all(r["k"] == 2 and r["strands"] == 2 and r["start"] < sizes[r["chrom"]] for r in pairs)
    long = queries.pacbio_reads(spark, DIR).select("chrom", F.length("seq").alias("size"), F.length("qual").alias("q")).collect()
    assert len(long) == n_events and all(0 < r["size"] <= sizes[r["chrom"]] and r["size"] == r["q"] for r in long)
    assert max(int(r["chrom"].split()[1].split(":")[0]) for r in pairs) > 96
    assert queries.evolve_tree(spark, DIR).select("chrom_id").distinct().count() > 0.9 * len(sizes)


def test_allocation(spark):
    """The total is kept, a sequence of half of all bases gets half of the reads, and partitions do not matter."""
    rows = [("a", f"c{i}", "T" * (i % 7)) for i in range(300)] + [("a", "hot", "T" * 900), ("a", "none", None), ("b", "c1", "T"), ("z", "c1", "")]
    frame = spark.createDataFrame(rows, "hap string, chrom string, seq string")
    w = {"a": 3.0, "b": 1.0, "z": 0.0}
    got, again = (sorted(map(tuple, allocate(frame.repartition(k), 80_000, w, 5).collect())) for k in (1, 7))
    assert got == again and sum(r[2] for r in got) == 80_000 and max(r[2] for r in got) <= CHUNK
    per = {}
    for h, c, n, _ in got:
        per[h, c] = per.get((h, c), 0) + n
    size = {(h, c): len(s or "") for h, c, s in rows}
    total = sum(n for (h, _), n in size.items() if h == "a")
    assert abs(per["b", "c1"] - 20_000) < 700 and abs(per["a", "hot"] - 60_000 * 900 / total) < 700
    assert all(size[k] for k in per) and sum(r[1] == "hot" for r in got) == -(-per["a", "hot"] // CHUNK)
    with pytest.raises(ValueError):
        allocate(frame, 10, {"a": 0.0, "b": 0.0, "z": 1.0}, 5)
    with pytest.raises(ValueError):
        allocate(frame.limit(0), 10, None, 5)
