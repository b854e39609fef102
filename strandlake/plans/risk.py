"""Polygenic risk: variants, an association catalog and an optional reference of rs numbers, up to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import genotype as G
from ..operators.dedup import median_rows


def sample_names(header: DataFrame) -> DataFrame:
    """file_path, names from the metadata table of VCF headers."""
    return header.where("key = 'samples'").select("file_path", F.split("value", "\t").alias("names"))


def scores(
    variants: DataFrame,
    header: DataFrame,
    catalog: DataFrame,
    dbsnp: DataFrame | None = None,
    min_quality: float = 0,
    only_pass: bool = False,
    dedup_catalog: bool = True,
) -> DataFrame:
    """Steps: filter, set rs numbers, long genotypes, doses (renumbered to the reference's alleles), catalog codes, sums."""
    v = G.passing(variants, min_quality, only_pass)
    c = median_rows(catalog, "OR", ["ids", "alt", "trait"], ties=["pubmedID", "date", "position"]) if dedup_catalog else catalog
    if dbsnp is not None:
        ref = G.numbered(dbsnp)
        v = v.withColumn("chromosome", G.chromosome_number(F.col("chromosome")).cast("string"))
        v, c = G.update_ids(v, ref, keep=False), G.update_ids(c, ref, overwrite=False).dropna(subset=["ids"])
        mapping = G.encode_alleles(v, ref)
        c = G.code_catalog(c, ref)
    else:
        v = v.withColumn("ids", G.rs_number(F.col("ids"))).dropna(subset=["ids"])
        mapping = None
        c = G.code_catalog(c, v)
    rows = G.fill_samples(G.sample_rows(v, sample_names(header)))
    return G.risk_scores(G.doses(rows, mapping), c)
