"""Genotypes in long form and polygenic risk scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.variant import alleles, chromosome_number, genotype_alleles, rs_number
from .dedup import keep_first


def allele_rows(variants: DataFrame, name: str = "code") -> DataFrame:
    """ids, code, allele: the reference is 0, alternatives 1, 2, ..."""
    return variants.select("ids", F.posexplode(alleles(F.col("references"), F.col("alts"))).alias(name, "allele"))


def numbered(dbsnp: DataFrame) -> DataFrame:
    """Numeric chromosomes, positions and ids; one row for each place and id."""
    d = dbsnp.select(chromosome_number(F.col("chromosome")).alias("chromosome"), F.col("position").try_cast("long").alias("position"), rs_number(F.col("ids")).alias("ids"), "references", "alts")
    return keep_first(d.dropna(subset=["chromosome", "position"]), ["chromosome", "position", "ids"], [F.col("references"), F.col("alts")])


def update_ids(rows: DataFrame, dbsnp: DataFrame, keep: bool = True, overwrite: bool = True) -> DataFrame:
    """Sets ``ids`` by (chromosome, position); without ``keep`` unmatched rows go. Several ids of a place: the smallest."""
    ref = dbsnp.groupBy(F.col("chromosome").alias("_c"), F.col("position").alias("_p")).agg(F.min("ids").alias("_ids"))
    place = (F.col("chromosome").cast("string").try_cast("int") == F.col("_c")) & (F.col("position").cast("string").try_cast("long") == F.col("_p"))
    d = rows.join(ref, place, "left" if keep else "inner")
    old = F.col("ids").cast("string").try_cast("long")
    value = F.coalesce(F.col("_ids"), old) if overwrite else F.coalesce(old, F.col("_ids"))
    return d.withColumn("ids", value).drop("_c", "_p", "_ids")


def encode_alleles(panel: DataFrame, dbsnp: DataFrame) -> DataFrame:
    """ids, code1k, code: numbers of equal alleles in the panel's rows and in the reference's."""
    a, b = allele_rows(panel, "code1k"), allele_rows(dbsnp, "code")
    return a.join(b, ["ids", "allele"]).select("ids", "code1k", "code").distinct()


def catalog_ids(catalog: DataFrame, dbsnp: DataFrame, overwrite: bool = False) -> DataFrame:
    """Association rows with the ids of their places; unmatched places go, and of equal (trait, ids, alt) the first by
    publication, date and odds ratio stays."""
    d = update_ids(catalog, dbsnp, keep=False, overwrite=overwrite).dropna(subset=["ids"])
    return keep_first(d, ["trait", "ids", "alt"], [F.col("pubmedID"), F.col("date"), F.col("OR")])


def mapped_codes(catalog: DataFrame, mapping: DataFrame) -> DataFrame:
    """Association rows whose ``code`` is renumbered by ``mapping`` (ids, code, code1k) to that of the panel; 0 if it has none."""
    m = mapping.select(F.col("ids").alias("_ids"), F.col("code").alias("_code"), "code1k").distinct()
    d = catalog.join(m, (F.col("ids") == F.col("_ids")) & (F.col("code") == F.col("_code")), "left")
    return d.withColumn("code", F.coalesce("code1k", F.lit(0))).drop("_ids", "_code", "code1k").distinct()


def code_catalog(catalog: DataFrame, dbsnp: DataFrame) -> DataFrame:
    """Association rows with the ``code`` of their risk allele; unknown ones go."""
    a = allele_rows(dbsnp).select(F.col("ids").alias("_ids"), F.col("allele").alias("_a"), "code").distinct()
    return catalog.join(a, (F.col("ids") == F.col("_ids")) & (F.col("alt") == F.col("_a"))).drop("_ids", "_a")


def sample_rows(variants: DataFrame, names: DataFrame) -> DataFrame:
    """ids, sample_name, gt: one row for each variant and sample; ``names``: file_path, sample names in the files' order.

    Long form from the start: the plan does not grow with the number of samples, files may differ in theirs.
    """
    n = names.select(F.col("file_path").alias("_path"), F.posexplode("names").alias("_i", "sample_name"))
    v = variants.select("file_path", "ids", F.posexplode("samples").alias("i", "gt"))
    return v.join(n, (F.col("file_path") == F.col("_path")) & (F.col("i") == F.col("_i"))).select("ids", "sample_name", "gt")


def fill_samples(rows: DataFrame) -> DataFrame:
    """Adds ``gt`` "0" for every variant in which a sample is missing."""
    samples = rows.select("sample_name").distinct()
    # as many rows as the result has; the samples go along with the ids if a count shows that they are few
    small = samples.limit(100_001).count() <= 100_000
    every = rows.select("ids").distinct().crossJoin(F.broadcast(samples) if small else samples)
    return every.join(rows, ["ids", "sample_name"], "left").withColumn("gt", F.coalesce("gt", F.lit("0")))


def missing_samples(names: DataFrame) -> DataFrame:
    """file_path, missing: the samples of the largest file that a file lacks, and extra: those it has beyond it."""
    top = names.agg(F.max_by("names", F.struct(F.size("names"), "file_path")).alias("top"))
    d = names.join(F.broadcast(top))
    return d.select("file_path", F.array_sort(F.array_except("top", "names")).alias("missing"), F.array_sort(F.array_except("names", "top")).alias("extra"))


def passing(variants: DataFrame, min_quality: float = 0, only_pass: bool = False) -> DataFrame:
    d = variants.where(F.col("qual").try_cast("double") >= min_quality) if min_quality > 0 else variants
    return d.where(F.col("filter") == "PASS") if only_pass else d


def doses(rows: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """sample_name, rsID, code, dose: how often a sample has an allele. ``mapping`` (ids, code1k, code) renumbers alleles;
    what it lacks becomes 0."""
    d = rows.select("sample_name", F.col("ids").alias("rsID"), F.explode(genotype_alleles(F.col("gt"))).alias("code"))
    if mapping is not None:
        m = mapping.select(F.col("ids").alias("_ids"), F.col("code1k").alias("_k"), F.col("code").alias("_code"))
        d = d.join(m, (F.col("rsID") == F.col("_ids")) & (F.col("code") == F.col("_k")), "left").withColumn("code", F.coalesce("_code", F.lit(0)))
    return d.groupBy("sample_name", "rsID", "code").agg(F.sum(F.lit(1.0)).alias("dose"))


def risk_scores(dose: DataFrame, catalog: DataFrame) -> DataFrame:
    """sample_name, trait, pubmedID, date, prs_score: sums of dose times odds ratio, ordered by sample and trait."""
    c = catalog.select(F.col("ids").alias("rsID"), "code", "OR", "trait", "pubmedID", "date")
    d = dose.join(c, ["rsID", "code"]).groupBy("sample_name", "trait", "pubmedID").agg(F.sum(F.col("dose") * F.col("OR")).alias("prs_score"), F.max("date").alias("date"))
    return d.select("sample_name", "prs_score", "trait", "pubmedID", "date").orderBy("sample_name", "trait", "pubmedID")
