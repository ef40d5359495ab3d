import random

import pytest

from strandloom.functions import dna
from strandloom.operators.genome import Genome
from strandloom.operators.haplotypes import Haplotypes
from strandloom.operators.mutations import Pieces


def rows(df, *keys):
    return [tuple(r) for r in df.orderBy(*keys).collect()]


def test_composition(spark):
    g = Genome.of(spark, ["T" * 50 + "C" * 50 + "A" * 50 + "G" * 50, "N" * 10, ""])
    assert [r["share"] for r in g.shares("GC").orderBy("chrom_id").collect()] == [0.5, 0, None]
    assert [r["share"] for r in g.shares("G", 151, 200).orderBy("chrom_id").collect()][0] == 1
    with pytest.raises(ValueError):
        g.shares("GC", 0, 3)


def test_replace_ns(spark):
    g = Genome.of(spark, ["CCAANNNGG", "NNTTCCAAGG", "AACCTTGGGGGNNNNNN"]).replace_ns([1, 0, 0, 0])
    assert [g.chrom(i) for i in range(3)] == ["CCAATTTGG", "TTTTCCAAGG", "AACCTTGGGGGTTTTTT"]


def test_names(spark):
    g = Genome.of(spark, ["T", "CC"], ["nonsense names 1 ';,\"", "b"]).clean_names()
    assert g.names() == ["nonsense_names_1_____", "b"]
    assert g.set_names(["x", "y"]).names() == ["x", "y"]
    with pytest.raises(ValueError):
        g.set_names(["x"])


def test_filters(spark):
    g = Genome.of(spark, ["T" * 3, "C" * 5, "A" * 2])
    assert g.filter_size(2).n_chroms() == 3 and g.filter_size(3).names() == ["chrom1", "chrom0"]
    assert g.filter_share(0.5).names() == ["chrom1"] and g.filter_share(0.6).names() == ["chrom1", "chrom0"]
    with pytest.raises(ValueError):
        g.filter_share(1)


def test_add_remove_merge(spark):
    g = Genome.of(spark, ["TT", "CC", "AA", "GG"])
    assert g.add(["T"]).names() == ["chrom0", "chrom1", "chrom2", "chrom3", "chrom4"]
    assert g.remove(["chrom1"]).names() == ["chrom0", "chrom2", "chrom3"]
    m = g.merge(["chrom2", "chrom0"])
    assert m.names() == ["chrom1", "chrom2__chrom0", "chrom3"] and m.chrom(2) == "AATT"
    assert g.merge_all().total_size() == 8
    for bad in (lambda: g.remove(["x"]), lambda: g.merge(["x"]), lambda: g.add(["T"], ["chrom0"]), lambda: g.remove(["chrom0", "chrom0"])):
        with pytest.raises(ValueError):
            bad()


def test_simulated(spark):
    g = Genome.simulate(spark, 4, 1000, 100, [8, 4, 2, 1], seed=3)
    assert g.chrom(2) == Genome.simulate(spark, 4, 1000, 100, [8, 4, 2, 1], seed=3).chrom(2)
    shares = [r["share"] for r in g.shares("T").collect()]
    assert abs(sum(shares) / 4 - 8 / 15) < 0.05
    assert "4 chromosomes" in repr(g)


def test_column_functions(spark):
    df = spark.sql("SELECT 'tcxgan' AS s, 'name rest' AS h")
    r = df.select(dna.filter_bases("s"), dna.reverse_complement(dna.filter_bases("s")), dna.cut_name("h"), dna.padded_read("s", dna.F.lit(4), 5), dna.filter_bases("s", True)).first()
    assert tuple(r) == ("TCGAN", "NTCGA", "name", "anNNN", "TCNGAN")
    assert [r[0] for r in spark.sql("SELECT explode(array('T','C','A','G','N','','TC')) AS b").select(dna.base_index("b")).collect()] == [0, 1, 2, 3, 4, 4, 4]
    assert [r[0] for r in spark.range(3).select(dna.even_part(8, 3, "id")).collect()] == [3, 3, 2]


def edits(rng, n):
    out = []
    for j in range(n):
        kind = rng.choices(["sub", "ins", "del"], [2, 1, 1])[0]
        size = min(10, int(rng.expovariate(2) + 1))
        out.append((j, kind, rng.random(), "".join(rng.choices("TCAG", k=1 if kind == "sub" else size)), size))
    return out


def test_edits_against_strings(spark):
    """Random edits mirrored on plain strings; the mutations must rebuild them."""
    rng = random.Random(5)
    refs = ["".join(rng.choices("TCAG", k=100)) for _ in range(4)]
    g = Genome.of(spark, refs)
    table, want = [], {}
    for h in range(3):
        for c, s in enumerate(refs):
            for j, kind, at, text, n in edits(rng, 60):
                if not s:
                    break
                p = int(at * len(s))
                table.append((h, c, j, kind, p, text, n))
                s = s[:p] + text + s[p + 1 :] if kind == "sub" else s[: p + 1] + text + s[p + 1 :] if kind == "ins" else s[:p] + s[p + n :]
            want[h, c] = s
    e = spark.createDataFrame(table, "hap_id int, chrom_id long, seq_no long, kind string, pos long, text string, n int")
    h = Haplotypes.empty(g, 3).edit(e)
    got = {(r["hap_id"], r["chrom_id"]): r["seq"] for r in h.sequences().collect()}
    assert got == want
    assert {(r["hap_id"], r["chrom_id"]): r["size"] for r in h.sizes().collect()} == {k: len(v) for k, v in want.items()}
    half = e.where("seq_no < 30"), e.where("seq_no >= 30")
    again = Haplotypes.empty(g, 3).edit(half[0]).edit(half[1])
    assert {(r["hap_id"], r["chrom_id"]): r["seq"] for r in again.sequences().collect()} == want


def test_pieces():
    p = Pieces("TCAGTCAGTC")
    p.substitute(2, "T")
    assert p.mutations() == [(2, 1, "T")]
    p.substitute(2, "A")  # back to the reference
    assert p.mutations() == []
    p.insert(2, "GG")
    assert p.mutations() == [(2, 1, "AGG")] and p.text() == "TCAGGGTCAGTC"
    p.delete(2, 4)
    assert p.text() == "TCTCAGTC"
    p.delete(6, 100)
    assert p.text() == "TCTCAG"
    with pytest.raises(ValueError):
        p.delete(6, 1)


def test_haplotype_sets(spark):
    g = Genome.of(spark, ["TCAGTC"])
    e = spark.createDataFrame([(0, 0, 0, "del", 1, "", 2)], "hap_id int, chrom_id long, seq_no long, kind string, pos long, text string, n int")
    h = Haplotypes.empty(g, 2).edit(e)
    d = h.duplicate(["hap0", "hap0"])
    assert d.names() == ["hap0", "hap1", "hap0_dup1", "hap0_dup2"] and d.chrom(3, 0) == "TGTC"
    assert h.add(["x"]).names() == ["hap0", "hap1", "x"] and h.remove(["hap0"]).names() == ["hap1"]
    assert h.set_names(["p", "q"]).names() == ["p", "q"] and "2 haplotypes" in repr(h)
    assert [tuple(r) for r in h.spectrum().collect()] == [("del", "C", "2", 1)]
    for bad in (lambda: h.add(["hap0"]), lambda: h.remove(["x"]), lambda: h.duplicate(["x"])):
        with pytest.raises(ValueError):
            bad()
