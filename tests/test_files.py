import gzip

import pytest

from strandloom.operators.genome import Genome
from strandloom.operators.haplotypes import Haplotypes, create_haplotypes
from strandloom.operators.mutations import SCHEMA
from strandloom.sources.fasta import read_fasta, read_indexed, write_fasta, write_hap_fasta
from strandloom.sources.vcf import hap_names, read_vcf, write_vcf

# The golden haplotypes: two chromosomes, four haplotypes, and the records they make.
REF = "TCAGTCAGTC"
MUTATIONS = {
    (0, 0): [(0, 3, ""), (5, 1, "T"), (6, 1, "")],
    (1, 0): [(1, 3, ""), (5, 1, "A"), (6, 2, "")],
    (2, 0): [(0, 3, ""), (5, 1, "A"), (6, 1, "T")],
    (3, 0): [(2, 2, ""), (5, 1, "G"), (7, 1, "T"), (8, 1, "")],
    (0, 1): [(0, 1, ""), (4, 1, "TTT"), (5, 1, "A"), (7, 1, "GA"), (8, 1, "")],
    (1, 1): [(1, 1, "CAG"), (4, 1, "TTT"), (5, 1, "A")],
    (2, 1): [(1, 2, ""), (4, 1, "TT"), (5, 1, "T")],
    (3, 1): [(1, 1, "CAG"), (2, 1, "T"), (4, 1, "TC"), (5, 1, "")],
}
RECORDS = [
    (0, 1, "TCAG", "G,T,TC", "1,2,1,3"),
    (0, 6, "CAGT", "TGT,AT,ATGT,GAT", "1,2,3,4"),
    (1, 1, "TCA", "CA,TCAGA,T,TCAGT", "1,2,3,4"),
    (1, 5, "TC", "TTTA,TTT", "1,1,2,0"),
    (1, 8, "GT", "GA", "1,0,0,0"),
]


@pytest.fixture
def golden(spark):
    g = Genome.of(spark, [REF, REF])
    rows = [(h, c, *m) for (h, c), ms in MUTATIONS.items() for m in ms]
    base = Haplotypes.empty(g, 4)
    return Haplotypes(g, base.haps, spark.createDataFrame(rows, SCHEMA))


def test_golden_sites(golden):
    got = [(r["chrom_id"], r["pos"], r["ref"], ",".join(r["alts"]), ",".join(map(str, r["gts"]))) for r in golden.genotypes().orderBy("chrom_id", "pos").collect()]
    assert got == RECORDS


def sequences(h):
    return {(r["hap_id"], r["chrom_id"]): r["seq"] for r in h.sequences().collect()}


@pytest.mark.parametrize("samples, compress", [(None, False), ([[1, 2], [3, 4]], True)])
def test_vcf_round_trip(spark, golden, tmp_path, samples, compress):
    path = write_vcf(golden, str(tmp_path / "x"), samples, compress)
    text = (gzip.open(path, "rt") if compress else open(path)).read().splitlines()
    body = [x.split("\t") for x in text if not x.startswith("#")]
    assert [(x[0], int(x[1]), x[3], x[4]) for x in body] == [(f"chrom{c}", p, r, a) for c, p, r, a, _ in RECORDS]
    calls = [",".join(":".join(c.split(":")[:1]) for c in x[9:]) for x in body]
    assert [c.replace("|", ",") for c in calls] == [r[4] for r in RECORDS]
    back = create_haplotypes(golden.genome, read_vcf(spark, path, golden.genome))
    assert back.names() == golden.names() and sequences(back) == sequences(golden)
    with pytest.raises(FileExistsError):
        write_vcf(golden, str(tmp_path / "x"), samples, compress)


def test_vcf_samples(golden, tmp_path):
    for bad in ([[0]], [[5]], [[1], [1]], [[1], [2, 3]]):
        with pytest.raises(ValueError):
            write_vcf(golden, str(tmp_path / "y"), bad)
    assert hap_names(["a", "b"], 2) == ["a_1", "a_2", "b_1", "b_2"] and hap_names(["a__b", "c__d"], 2) == ["a", "b", "c", "d"]


def test_vcf_errors(spark, golden, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n"
    for name, body in {"overlap": "chrom0\t1\t.\tTCA\tT\t.\t.\t.\tGT\t1\nchrom0\t2\t.\tC\tA\t.\t.\t.\tGT\t1\n", "contig": "other\t1\t.\tT\tC\t.\t.\t.\tGT\t1\n", "symbol": "chrom0\t1\t.\tT\t<DEL>\t.\t.\t.\tGT\t1\n", "ploidy": "chrom0\t1\t.\tT\tC\t.\t.\t.\tGT\t1\nchrom0\t5\t.\tT\tC\t.\t.\t.\tGT\t1|0\n"}.items():
        (tmp_path / name).write_text(head + body)
        with pytest.raises(ValueError):
            read_vcf(spark, str(tmp_path / name), golden.genome)
    (tmp_path / "ok").write_text(head + "chrom1\t2\t.\tC\tG\t.\t.\t.\tGT:GQ\t1:9\nchrom0\t2\t.\tC\tG\t.\t.\t.\tGQ\t9\nchrom0\t4\t.\tG\tA\t.\t.\t.\tGT\t.\n")
    h = create_haplotypes(golden.genome, read_vcf(spark, str(tmp_path / "ok"), golden.genome))
    assert sequences(h) == {(0, 0): REF, (0, 1): "TGAGTCAGTC"}


@pytest.mark.parametrize("compress", [None, "gzip", "bgzip"])
def test_fasta_round_trip(spark, tmp_path, compress):
    g = Genome.simulate(spark, 5, 200, 30, seed=1)
    want = [(i, g.names()[i], g.chrom(i)) for i in range(5)]
    path = write_fasta(g, str(tmp_path / "g"), 80, compress)
    back = read_fasta(spark, path).chroms.orderBy("chrom_id").collect()
    assert [(r["chrom_id"], r["name"], r["seq"]) for r in back] == want
    two = read_fasta(spark, [path, path])
    assert two.n_chroms() == 10 and two.chrom(7) == want[2][2]


def test_fasta_details(spark, tmp_path):
    f = tmp_path / "a.fa"
    f.write_bytes(b">one first > more\nTcaX\r\nGN\n>two\n\n>three x\nAA\n")
    got = [(r["name"], r["seq"]) for r in read_fasta(spark, str(f), cut_names=True).chroms.orderBy("chrom_id").collect()]
    assert got == [("one", "TCAGN"), ("two", ""), ("three", "AA")]


def test_fasta_index(spark, tmp_path):
    f = tmp_path / "a.fa"
    f.write_text(">x\nTCAG\nTC\n>y\nGGGG\nAAAA\nT\n")
    (tmp_path / "a.fa.fai").write_text("x\t6\t3\t4\t5\ny\t9\t14\t4\t5\n")
    got = [r["seq"] for r in read_indexed(spark, str(f), str(tmp_path / "a.fa.fai")).chroms.orderBy("chrom_id").collect()]
    assert got == ["TCAGTC", "GGGGAAAAT"]


def test_hap_fasta(spark, golden, tmp_path):
    paths = write_hap_fasta(golden, str(tmp_path / "h"))
    assert len(paths) == 4
    for h, p in enumerate(paths):
        back = [r["seq"] for r in read_fasta(spark, p).chroms.orderBy("chrom_id").collect()]
        assert back == [sequences(golden)[h, 0], sequences(golden)[h, 1]]
