"""Variant tables: chromosomes, rs numbers, alleles, genotypes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chromosome_number(name: Column) -> Column:
    """1..25 (X 23, Y 24, M or MT 25) from ``NC_000007.13``, ``chr7``, ``7``, ``chrX``; null for anything else."""
    bare = F.upper(F.coalesce(F.nullif(F.regexp_extract(name, r"^NC_0*(\d+)(?:\.|$)", 1), F.lit("")), F.regexp_replace(name, "^(?i:chr)", "")))
    number = F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25).otherwise(bare.try_cast("int"))
    return F.when(number.between(1, 25), number)


def rs_number(ids: Column) -> Column:
    return F.regexp_replace(ids.cast("string"), "^rs", "").try_cast("long")


def alleles(reference: Column, alternatives: Column) -> Column:
    """The reference allele (number 0) and the alternatives (1, 2, ...) in an array."""
    return F.split(F.concat_ws(",", reference, alternatives), ",")


def genotype_alleles(genotype: Column) -> Column:
    """Allele numbers of the first sub-field, split at ``|`` or ``/``; a missing one is 0."""
    return F.transform(F.split(F.get(F.split(genotype, ":"), F.lit(0)), r"[|/]"), lambda a: F.coalesce(a.try_cast("int"), F.lit(0)))
