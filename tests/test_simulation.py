import numpy as np
import pytest

from strandloom.operators import reads as R
from strandloom.operators.evolve import evolve
from strandloom.operators.genome import Genome
from strandloom.operators.haplotypes import GeneTrees, Phylo, SegSites, Theta, create_haplotypes, regions
from strandloom.operators.mutations import Pieces
from strandloom.plans import models
from strandloom.sources import ms, newick, profiles, rates

MS = """ms 3 2
1 2 3

//
[4]((1:0.1,2:0.1):0.2,3:0.3);
[6](1:0.3,(2:0.1,3:0.1):0.2);
segsites: 2
positions: 0.1 0.52
01
10
11

//
((1:0.1,3:0.1):0.2,2:0.3);
segsites: 1
positions: 0.3
1
0
0
"""


def test_newick():
    t = newick.parse("((a:1,'b c':2)x:3,d:4.5e0);")
    assert t.tips == ["a", "b c", "d"] and t.total_length() == 10.5 and newick.parse(newick.parse("((a:1,b:2):3,d:4);").newick()).edges == newick.parse("((a:1,b:2):3,d:4);").edges
    for bad in ("(a:1,b:1,c:1);", "((a:1,b:1);", "(a,b:1);", "(a:1,a:1);"):
        with pytest.raises(ValueError):
            newick.parse(bad)
    c = newick.coalescent(6, np.random.default_rng(1))
    assert len(c.edges) == 10 and len(c.tips) == 6


def test_ms(spark):
    trees = ms.parse_trees(MS)
    assert [len(x) for x in trees] == [2, 1] and trees[0][1].size == 6
    assert ms.parse_trees("//\n" + ms.trees_text(trees).removeprefix("//\n"))[0][0].size == 4
    sites = ms.parse_sites(MS)
    assert sites[0] == ([0.1, 0.52], ["01", "10", "11"])
    assert ms.sites_frame(spark, sites).where("allele = 1").count() == 5
    for bad in (MS.replace("[6]", ""), MS.replace("positions: 0.3", "positions:"), MS.replace("11\n", "1\n"), MS.replace("(2:0.1,3:0.1)", "(2:0.1,9:0.1)")):
        with pytest.raises(ValueError):
            ms.parse_trees(bad)
            ms.parse_sites(bad)


def test_write_trees(tmp_path):
    p = ms.write_trees(ms.parse_trees(MS), str(tmp_path / "x"))
    assert p.endswith("x.trees") and [len(x) for x in ms.read_trees(p)] == [2, 1]
    with pytest.raises(FileExistsError):
        ms.write_trees(ms.parse_trees(MS), str(tmp_path / "x"))


def test_regions():
    t = ms.parse_trees(MS)[0]
    assert [(a, b) for a, b, _ in regions(t, 10)] == [(0, 4), (4, 10)]
    shares = [ms.RegionTree(x, t[0].tree) for x in (0.25, 0.75)]
    assert [(a, b) for a, b, _ in regions(shares, 10)] in ([(0, 2), (2, 10)], [(0, 3), (3, 10)])
    with pytest.raises(ValueError):
        regions(t, 11)


def test_evolution_matches_transition():
    """Shares of bases after a branch follow P(t), and mutations rebuild the sequence."""
    ref = "TCAG" * 5000
    sub = models.hky85([0.1, 0.2, 0.3, 0.4], 1.0, 0.5)
    tree = newick.parse("(a:0.4,b:0.0);")
    a, b = evolve(ref, 0, tree, sub, None, None, 0.03, (1,))
    assert b == []
    p = sub.transition(0.4)
    changed = {i: 0 for i in range(4)}
    for pos, _, alt in a:
        changed["TCAG".index(ref[pos])] += 1
        assert alt != ref[pos]
    for i in range(4):
        assert abs(changed[i] / 5000 - (1 - p[i, i])) < 0.03


@pytest.mark.parametrize("epsilon", [0.0, 0.03])
def test_indel_evolution(epsilon):
    ref = "TCAGTTGACC" * 30
    tree = newick.parse("((a:0.5,b:0.4):0.1,c:0.6);")
    ins, dels = models.indels(0.1, 5), models.indels(0.1, 5)
    for h in evolve(ref, 7, tree, models.jc69(1.0), ins, dels, epsilon, (2, epsilon)):
        ms_ = [(p - 7, n, alt) for p, n, alt in h]
        assert ms_ and all(0 <= p < len(ref) for p, _, _ in ms_)
        ends = [p + n for p, n, _ in ms_]
        assert all(e <= p for e, (p, _, _) in zip(ends, ms_[1:], strict=False))
        assert len(Pieces(ref, ms_)) == len(ref) + sum(len(alt) - n for _, n, alt in ms_)


def test_methods(spark):
    g = Genome.simulate(spark, 2, 400, seed=2)
    sub = models.jc69(1.0)
    few = create_haplotypes(g, Theta(0.01, 4), sub, seed=1).mutations.count()
    many = create_haplotypes(g, Theta(0.2, 4), sub, seed=1).mutations.count()
    assert many > few
    t = newick.parse("((x:0.1,y:0.1):0.1,z:0.2);")
    h = create_haplotypes(g, Phylo([t]), sub, models.indels(0.05), models.indels(0.05), seed=4)
    assert h.names() == ["x", "y", "z"]
    first = sorted(map(tuple, h.mutations.collect()))
    assert first == sorted(map(tuple, create_haplotypes(g, Phylo([t]), sub, models.indels(0.05), models.indels(0.05), seed=4).mutations.repartition(7).collect()))
    trees = [[ms.RegionTree(150, t), ms.RegionTree(250, t)], [ms.RegionTree(None, t)]]
    assert create_haplotypes(g, GeneTrees(trees), sub, seed=4).sequences().count() == 6
    with pytest.raises(ValueError):
        create_haplotypes(g, Theta(0.1, 4))


def test_seg_sites(spark):
    g = Genome.of(spark, ["TCAG" * 25, "GATC" * 25])
    sites = ms.sites_frame(spark, ms.parse_sites(MS))
    h = create_haplotypes(g, SegSites(sites), models.jc69(1.0), seed=3)
    assert h.mutations.count() == sites.where("allele = 1").count()
    assert {(r["chrom_id"], r["old_pos"]) for r in h.mutations.collect()} == {(0, 10), (0, 52), (1, 30)}
    assert ms.matrix_sites(spark, [[[0.5, 0, 1]]]).count() == 2
    with pytest.raises(ValueError):
        ms.matrix_sites(spark, [[[0.5, None, 1]]])


def fixed(length):
    q = [[np.array([93])] * length for _ in range(4)]
    c = [[np.array([1.0])] * length for _ in range(4)]
    return profiles.Profile(q, c)


@pytest.mark.parametrize("matepair, allowed", [(False, {"C25N75", "A25N75"}), (True, {"N75T25", "N75G25"})])
def test_read_geometry(spark, matepair, allowed):
    seqs = spark.createDataFrame([("REF", "c", "C" * 25 + "N" * 150 + "T" * 25)], "hap string, chrom string, seq string")
    s = R.Illumina(100, matepair=matepair, frag_min=200, frag_max=200, ins_prob=(0, 0), del_prob=(0, 0), profiles=(fixed(100), fixed(100)))
    got = R.illumina(seqs, 100, s, seed=1).collect()
    assert len(got) == 100

    def shape(x):
        return f"{x[0]}75{x[-1]}25" if x[0] == "N" else f"{x[0]}25{x[-1]}75"

    assert {shape(r["seq"]) for r in got} == allowed
    assert sorted(r["mate"] for r in got) == [1] * 50 + [2] * 50


def test_reads(spark, tmp_path):
    from strandloom.sources.fastq import write_fastq

    seqs = spark.createDataFrame([("a", "c", "TCAG" * 200), ("b", "c", "GATC" * 200)], "hap string, chrom string, seq string")
    r = R.illumina(seqs, 200, R.Illumina(50, paired=False, prob_dup=0.3), weights={"a": 1, "b": 0}, seed=5).cache()
    assert r.count() == 200 and {x["hap"] for x in r.collect()} == {"a"}
    assert all(len(x["seq"]) == len(x["qual"]) == 50 for x in r.collect())
    lines = open(write_fastq(r, str(tmp_path / "r"))[0]).read().splitlines()
    assert len(lines) == 800 and lines[0].startswith("@a-c-") and lines[2] == "+"
    bar = R.illumina(seqs, 20, R.Illumina(50, paired=False, ins_prob=(0, 0), del_prob=(0, 0), profiles=(fixed(50),) * 2), barcodes={"a": "TTTTT", "b": "CCCCC"}, seed=6).collect()
    assert all(x["seq"].startswith("TTTTT" if x["hap"] == "a" else "CCCCC") for x in bar)
    for bad in (lambda: R.Illumina(ins_prob=(0.9, 0), del_prob=(0.2, 0)), lambda: R.PacBio(ins_prob=1.0), lambda: R.illumina(seqs, 3)):
        with pytest.raises(ValueError):
            bad()


def test_pacbio(spark):
    seqs = spark.createDataFrame([("a", "c", "TCAG" * 2000)], "hap string, chrom string, seq string")
    s = R.PacBio(lengths=([100, 1000], [1, 1]))
    got = R.pacbio(seqs, 60, s, seed=1).collect()
    assert len(got) == 60 and all(len(r["seq"]) == len(r["qual"]) for r in got) and {len(r["seq"]) for r in got} == {100, 1000}
    assert np.isclose(sum(p ** R.least_exponent((0.11, 0.04, 0.01), 0.2) for p in (0.11, 0.04, 0.01)), 0.2, atol=1e-6) or sum((0.11, 0.04, 0.01)) < 0.2


def test_profiles(spark, tmp_path):
    f = tmp_path / "p.txt"
    f.write_text("".join(f"{b}\t{p}\t10\t20\n{b}\t{p}\t1\t4\n" for b in "TCAG" for p in range(3)) + ".\t0\t1\n")
    x = profiles.read_profile(spark, str(f), 2)
    assert x.length == 2 and list(x.quals[0][0]) == [10, 20] and np.allclose(x.cumulative[3][1], [0.25, 1])
    with pytest.raises(ValueError):
        profiles.read_profile(spark, str(f), 4)
    assert profiles.find_system(spark, 90) == ("HS20", 100) and profiles.find_system(spark, 120, "HS25") == ("HS25", 125)
    with pytest.raises(ValueError):
        profiles.find_system(spark, 300)


def test_rates(spark):
    assert rates.evo_rates(spark).count() == 15


def test_pacbio_deletions_at_full_length(spark):
    """A read as long as its chromosome deletes only what insertions have given it room for; shorter ones delete freely."""
    seq = "".join(np.random.default_rng(2).choice(list("TCAG"), 2000))
    seqs = spark.createDataFrame([("a", "c", seq)], "hap string, chrom string, seq string")
    many = R.PacBio(lengths=([500], [1]), ins_prob=0.001, del_prob=0.3, sub_prob=0.001)
    short = R.pacbio(seqs, 200, many, seed=2).collect()
    assert {len(r["seq"]) for r in short} == {500}
    # reads with deletions reach further than their length, also near the end, and never beyond it
    assert max(r["start"] for r in short) < 1500 and any(r["start"] > 1200 for r in short)
    whole = R.pacbio(seqs, 40, R.PacBio(lengths=([2000], [1]), ins_prob=0.1, del_prob=0.1, sub_prob=0.001), seed=3).collect()
    assert all(r["start"] >= 0 and 1900 < len(r["seq"]) <= 2000 for r in whole)


def test_mates_stay_together(spark, tmp_path):
    """Line for line, files of first and second mates hold the same pairs, however many partitions made them."""
    from strandloom.sources.fastq import write_fastq

    rng = np.random.default_rng(4)
    seqs = spark.createDataFrame([(h, c, "".join(rng.choice(list("TCAG"), 900))) for h in ("a", "b") for c in ("x", "y", "z")], "hap string, chrom string, seq string").repartition(5)
    reads = R.illumina(seqs, 400, R.Illumina(read_length=50, frag_mean=200, frag_sd=40, prob_dup=0.2), seed=5)
    first, second = write_fastq(reads, f"{tmp_path}/r", paired=True)
    by_id = {(r["hap"], r["chrom"], r["chunk"], r["n"], r["mate"]): r["seq"] for r in reads.collect()}
    keys = sorted({k[:4] for k in by_id})
    for name, mate in ((first, 1), (second, 2)):
        lines = open(name).read().split("\n")
        assert lines[1::4] == [by_id[(*k, mate)] for k in keys] and len(keys) == 200


def test_tables_of_names_and_sequences(spark):
    """Removing, adding and renaming by tables equals doing so by lists, and unknown or used names are errors."""
    from strandloom.operators.genome import Genome

    g = Genome.of(spark, ["TC", "AG", "TT"], ["c0", "c1", "c7"])
    names = spark.createDataFrame([("c1",)], "name string")
    assert sorted(map(tuple, g.remove(names).chroms.collect())) == sorted(map(tuple, g.remove(["c1"]).chroms.collect()))
    with pytest.raises(ValueError):
        g.remove(spark.createDataFrame([("no",)], "name string"))
    more = spark.createDataFrame([(1, "e", "A"), (0, "d", "C")], "at long, name string, seq string")
    assert g.add(more).names() == g.add(["C", "A"], ["d", "e"]).names() == ["c0", "c1", "c7", "d", "e"]
    with pytest.raises(ValueError):
        g.add(spark.createDataFrame([(0, "c7", "A")], "at long, name string, seq string"))
    assert g.add(["A"]).names()[-1] == "chrom8"
    new = spark.createDataFrame([(2, "z"), (0, "x"), (1, "y")], "chrom_id long, name string")
    assert g.set_names(new).names() == ["x", "y", "z"]
    with pytest.raises(Exception, match="no name"):
        g.set_names(new.limit(1)).chroms.collect()


def test_vcf_out_of_order(spark, tmp_path):
    from strandloom.operators.genome import Genome
    from strandloom.sources.vcf import read_vcf

    g = Genome.of(spark, ["TCAGTCAG"], ["c"])
    top = "##fileformat=VCFv4.3\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n"
    rows = ["c\t2\t.\tC\tA\t.\t.\t.\tGT\t1\n", "c\t5\t.\tT\tG\t.\t.\t.\tGT\t1\n"]
    (tmp_path / "a.vcf").write_text(top + "".join(rows))
    assert read_vcf(spark, f"{tmp_path}/a.vcf", g).records.count() == 2
    (tmp_path / "b.vcf").write_text(top + "".join(rows[::-1]))
    with pytest.raises(ValueError, match="order"):
        read_vcf(spark, f"{tmp_path}/b.vcf", g)
