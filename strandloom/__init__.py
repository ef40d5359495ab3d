"""Genome, haplotype and sequencing-read analytics as Spark DataFrames."""
