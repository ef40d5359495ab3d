"""Steps whose time must grow no faster than their input, with the results that they had before."""

import hashlib
import time

import numpy as np
import pytest

from strandloom import queries
from strandloom.operators import mutations as M
from strandloom.operators import reads as R
from strandloom.operators import vcf_sites as V
from strandloom.operators.evolve import evolve
from strandloom.operators.genome import simulated_bases
from strandloom.plans import models
from strandloom.sources import newick
from strandloom.sources.profiles import Profile, falling


def digest(x):
    return hashlib.md5(repr(x).encode()).hexdigest()


def test_evolution_is_as_before_and_linear():
    """The same mutations as when every event copied the region, and no copy for every event of a long region."""
    tree = newick.parse("((a:0.1,b:0.1):0.05,(c:0.07,d:0.07):0.08);")
    sub, one, i = models.hky85([0.1, 0.2, 0.3, 0.4], 0.5, 0.25, gamma_shape=1.0, invariant=0.1), models.jc69(1.0), models.indels(0.1)
    seqs = ["".join(np.random.default_rng(k).choice(list("TCAGN"), n)) for k, n in enumerate((1, 2, 7, 60, 400, 3000))]
    got = [evolve(s, 5, tree, m, ins, i, e, (k, e)) for k, s in enumerate(seqs) for m, ins in ((sub, i), (one, None)) for e in (0.03, 0.0)]
    assert digest(got) == "83734c0bdd6447fa646616b59364dee9"
    began = time.process_time()
    assert sum(map(len, evolve("TCAG" * 50_000, 0, tree, sub, i, i, 0.0001, (1,)))) == 111_657
    assert time.process_time() - began < 4  # 8.2 s with copies, 0.9 s without


@pytest.fixture(scope="module")
def seqs(spark):
    rng = np.random.default_rng(7)
    return spark.createDataFrame([(h, f"c{n}", "".join(rng.choice(list("TCAGN"), n))) for h in ("a", "b") for n in (1, 3, 60, 149, 700, 5000)], "hap string, chrom string, seq string").cache()


def test_short_reads_are_as_before_and_drawn_together(spark, seqs):
    """The same reads as when each base was drawn by itself; adaptive execution does not put all blocks into one task."""
    uneven = Profile([[np.arange(2, 3 + (b + p) % 5) for p in range(40)] for b in range(4)], [[np.arange(1, 2 + (b + p) % 5) / (1 + (b + p) % 5) for p in range(40)] for b in range(4)])
    kinds = [R.Illumina(prob_dup=0.3), R.Illumina(150, ins_prob=(0.1, 0.05), del_prob=(0.1, 0.3), barcodes=("TTTTT",)), R.Illumina(50, matepair=True, frag_max=90, profiles=(uneven, falling(50))), R.Illumina(36, paired=False, ins_prob=(0, 0), del_prob=(0, 0))]
    got = [sorted(map(tuple, R.illumina(seqs, 600, s, {"a": 1, "b": 2}, {"a": "TTTTT"}, seed=i).collect())) for i, s in enumerate(kinds)]
    assert digest(got) == "2cca9c96f5766823870c16953dd560a2"
    one = seqs.where("hap = 'a' AND chrom = 'c5000'")
    began = time.time()
    assert R.illumina(one, 20_000, seed=1).count() == 20_000
    assert time.time() - began < 7  # 0.6 ms a read before, so 12 s
    many = spark.range(3000).selectExpr("'a' AS hap", "concat('c', id) AS chrom", "'TCAG' AS seq")
    assert R.allocate(many, 9000, None, 1).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_long_reads_are_as_before(spark, seqs):
    kinds = [R.PacBio(prob_dup=0.3), R.PacBio(lengths=([100, 1000], [1, 1]), del_prob=0.3), R.PacBio(ins_prob=0.5, sub_prob=0.3, del_prob=0.1)]
    got = [sorted(map(tuple, R.pacbio(seqs, 300, s, {"a": 1, "b": 2}, seed=i).collect())) for i, s in enumerate(kinds)]
    assert digest(got) == "e885d2de4b3a5d3ca7181d31befd5d81"


def counted(spark, frame):
    """frame through a step that counts the rows each time they are made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return frame.mapInArrow(run, frame.schema), made


def test_chromosomes_are_made_once_for_all_haplotypes(spark):
    g, made = counted(spark, spark.range(40).selectExpr("id AS chrom_id", "repeat('TCAG', 20) AS seq"))
    none = spark.createDataFrame([], M.SCHEMA)
    assert M.sizes(g, queries.haps(spark), none).count() == 320 and made.value == 40
    assert M.materialize(g, queries.haps(spark), none).where("length(seq) = 80").count() == 320 and made.value == 80


def test_alleles_are_made_once_for_genotypes(spark):
    g = spark.range(40).selectExpr("id AS chrom_id", "repeat('TCAG', 20) AS seq")
    m, made = counted(spark, spark.range(320).selectExpr("CAST(id % 8 AS int) AS hap_id", "id div 8 AS chrom_id", "4 * (id % 3) AS old_pos", "1 AS ref_len", "CASE WHEN id % 2 = 0 THEN 'G' ELSE 'A' END AS alt"))
    rows = V.genotypes(g, m, queries.haps(spark)).collect()
    assert len(rows) == 120 and made.value <= 2 * 320  # for the islands and for their mutations
    assert all([r["alts"][i - 1] for i in r["gts"] if i][0] == r["alts"][0] and len(r["alts"]) == 2 for r in rows)


def test_many_edits_of_one_chromosome():
    """Edits equal those of a plain string, without a walk in Python over all pieces for each of them."""
    rng = np.random.default_rng(5)
    ref = "".join(rng.choice(list("TCAG"), 50_000))
    want, p, began = ref, M.Pieces(ref), time.process_time()
    for kind, at in zip(rng.integers(0, 3, 4000).tolist(), rng.integers(0, 2**40, 4000).tolist(), strict=True):
        at %= len(p)
        if kind == 0:
            p.substitute(at, "G")
            want = want[:at] + "G" + want[at + 1 :]
        elif kind == 1:
            p.insert(at, "ACA")
            want = want[: at + 1] + "ACA" + want[at + 1 :]
        else:
            p.delete(at, 2)
            want = want[:at] + want[at + 2 :]
    took = time.process_time() - began
    assert p.text() == want and len(p) == len(want)
    assert M.Pieces(ref, M.merged(p.mutations())).text() == want
    assert took < 5, took


def test_simulated_bases_are_dealt_to_tasks(spark):
    """A small file of sizes is not one task, and the bases are those of the SQL (see test_queries)."""
    sizes = spark.range(0, 40, 1, 1).selectExpr("id AS chrom_id", "id AS size")
    got = simulated_bases(sizes, [1, 1, 1, 1], 3)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(len(r["seq"]) == r["chrom_id"] for r in got.collect())
