"""ms-style coalescent output: gene trees by region, and segregating sites."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .newick import Tree, parse

SITES = "chrom_id long, site_id long, pos double, hap_id int, allele int"


@dataclass(frozen=True)
class RegionTree:
    size: float | None
    tree: Tree


def _blocks(text: str) -> list[list[str]]:
    """Lines of each chromosome; what stands before the first // is the header."""
    parts = re.split(r"(?m)^//[^\n]*$", text)
    if any(x.startswith(("[", "(")) for x in parts[0].splitlines()):
        raise ValueError("a tree stands before the first //")
    return [[x.strip() for x in p.splitlines() if x.strip()] for p in parts[1:]]


def parse_trees(text: str) -> list[list[RegionTree]]:
    out = []
    for lines in _blocks(text):
        trees = []
        for line in lines:
            if line[0] in "[(":
                m = re.match(r"(?:\[([0-9.eE+-]+)\])?(.*)$", line)
                trees.append(RegionTree(float(m[1]) if m[1] else None, parse(m[2])))
        if not trees:
            raise ValueError("a chromosome has no gene trees")
        if len(trees) > 1 and any(t.size is None for t in trees):
            raise ValueError("with several trees each needs the size of its region in square brackets")
        labels = sorted(trees[0].tree.tips)
        if any(sorted(t.tree.tips) != labels for t in trees):
            raise ValueError("trees have differing tip labels")
        out.append(trees)
    if out and any(sorted(x[0].tree.tips) != sorted(out[0][0].tree.tips) for x in out):
        raise ValueError("trees have differing tip labels")
    return out


def read_trees(path: str) -> list[list[RegionTree]]:
    with open(path) as f:
        return parse_trees(f.read())


def parse_sites(text: str) -> list[tuple[list[float], list[str]]]:
    """Positions, and one string of 0 and 1 per haplotype, of every chromosome."""
    out = []
    for lines in _blocks(text):
        n = next((int(x.split(":")[1]) for x in lines if x.startswith("segsites:")), None)
        positions = next((list(map(float, x.split(":")[1].split())) for x in lines if x.startswith("positions:")), [])
        rows = [x for x in lines if re.fullmatch(r"[01]+", x)]
        if n is None or n and not rows:
            raise ValueError("a chromosome has no segregating sites")
        if len(positions) != n:
            raise ValueError("the number of positions differs from segsites")
        if any(len(r) != n for r in rows):
            raise ValueError("a haplotype's row has not one character per site")
        out.append((positions, rows))
    if len({len(r) for _, r in out if r}) > 1:
        raise ValueError("chromosomes have different numbers of haplotypes")
    return out


def sites_frame(spark: SparkSession, sites: list[tuple[list[float], list[str]]]) -> DataFrame:
    """One row per site and haplotype."""
    rows = [(c, s, p, h, int(r[s])) for c, (positions, hs) in enumerate(sites) for s, p in enumerate(positions) for h, r in enumerate(hs)]
    return spark.createDataFrame(rows, SITES)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    with open(path) as f:
        return sites_frame(spark, parse_sites(f.read()))


def matrix_sites(spark: SparkSession, matrices: list[list[list[float]]]) -> DataFrame:
    """In-memory sites: per chromosome, rows of position followed by 0 or 1 for each haplotype."""
    for m in matrices:
        if any(v is None or v != v for r in m for v in r) or any(v not in (0, 1) for r in m for v in r[1:]):
            raise ValueError("sites must be complete, and alleles 0 or 1")
    return spark.createDataFrame([(c, s, float(r[0]), h, int(v)) for c, m in enumerate(matrices) for s, r in enumerate(m) for h, v in enumerate(r[1:])], SITES)


def trees_text(chroms: list[list[RegionTree]]) -> str:
    def line(t: RegionTree) -> str:
        return ("" if t.size is None else f"[{t.size:g}]") + t.tree.newick()

    return "".join("//\n" + "\n".join(map(line, trees)) + "\n\n" for trees in chroms)


def write_trees(chroms: list[list[RegionTree]], prefix: str, overwrite: bool = False) -> str:
    path = f"{prefix}.trees"
    with open(path, "w" if overwrite else "x") as f:
        f.write(trees_text(chroms))
    return path
