"""Published mutation rates and population sizes of fifteen species."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "domain string, species string, Ge double, Gc_Gnc double, indels double, subs double, Ne double, pi_s double, theta_s double"

# Fixed values.
RATES = [
    ("Bacteria", "Agrobacterium tumefaciens", 0.5, 0.57, 0.3, 2.92, 342.47, 0.2, None),
    ("Bacteria", "Bacillus subtilis", 0.36, 0.43, 1.2, 3.35, 61.19, None, 0.041),
    ("Bacteria", "Escherichia coli", 0.39, 0.46, 0.37, 2.0, 179.6, None, 0.071),
    ("Bacteria", "Mesoplasma florum", 0.07, 0.08, 23.1, 97.8, 1.07, None, 0.021),
    ("Bacteria", "Pseudomonas aeruginosa", 0.59, 0.67, 0.14, 0.79, 210.7, 0.033, None),
    ("Bacteria", "Staphlyococcus epidermidis", 0.21, 0.26, 1.13, 7.4, 35.14, None, 0.052),
    ("Bacteria", "Vibrio cholerae", 0.34, 0.39, 0.18, 1.15, 478.26, None, 0.11),
    ("Eukarya", "Arabidopsis thaliana", 4.21, 5.55, 11.2, 69.5, 0.29, None, 0.008),
    ("Eukarya", "Caenorhabditis elegans", 2.5, 6.37, 6.69, 14.5, 0.54, None, 0.003),
    ("Eukarya", "Chlamydomonas reinhardtii", 3.92, 5.51, 0.44, 3.8, 43.31, None, 0.032),
    ("Eukarya", "Drosophila melanogaster", 2.32, 8.86, 4.61, 51.65, 0.86, None, 0.018),
    ("Eukarya", "Homo sapiens", 3.65, 21.75, 18.2, 135.13, 0.02, None, 0.001),
    ("Eukarya", "Mus musculus", 3.55, 27.17, 3.1, 54.0, 1.77, 0.004, None),
    ("Eukarya", "Paramecium tetraurelia", 5.68, 7.28, 0.04, 0.19, 101.8, None, 0.008),
    ("Eukarya", "Saccharomyces cerevisiae", 0.87, 1.02, 0.92, 2.63, 7.78, None, 0.004),
]


def evo_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, SCHEMA)


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """The same table from a CSV file in which NA is null."""
    return spark.read.csv(path, header=True, schema=SCHEMA, nullValue="NA")
