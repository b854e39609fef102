"""Coding sequences and gene clusters out of raw features; containment; sequence fill and translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import loc
from ..functions.seq import slice_strand, translate


def cds_from_features(features: DataFrame) -> DataFrame:
    q = F.col("qualifiers")
    return features.where(F.col("type") == "CDS").select(
        "file_path",
        "source_path",
        "seq_id",
        loc.envelope(F.col("location")).alias("location"),
        loc.qualifier(q, "locus_tag").alias("locus_tag"),
        loc.qualifier(q, "gene").alias("gene_name"),
        F.coalesce(loc.qualifier(q, "protein_id"), loc.qualifier(q, "product")).alias("protein_name"),
        loc.qualifier(q, "translation").alias("aa_sequence"),
        loc.numeric_qualifier(q, "transl_table").alias("transl_table"),
        loc.other_qualifiers(q, "locus_tag", "gene", "protein_id", "translation", "transl_table").alias("other_qualifiers"),
    )


#: source: (feature type, qualifier of the classes, qualifier of the contig edge)
CLUSTER_SOURCES = {"antismash": ("region", "product", "contig_edge"), "smc": ("cluster", "BGC_Class", None)}


def clusters_from_features(features: DataFrame, source: str = "antismash", type_: str | None = None, classes: str | None = None) -> DataFrame:
    """Clusters of a known source, or of ``custom`` with its feature type and class qualifier; without a class: dropped."""
    if source == "custom":
        if not type_ or not classes:
            raise ValueError("a custom source needs the feature type and the qualifier of its classes")
        kind, key, edge = type_, classes, None
    elif source in CLUSTER_SOURCES:
        kind, key, edge = CLUSTER_SOURCES[source]
    else:
        raise NotImplementedError(source)
    q = F.col("qualifiers")
    on_edge = loc.qualifier(q, edge) == "True" if edge else F.lit(None).cast("boolean")
    rest = [key, edge] if edge else [key]
    d = features.where(F.col("type") == kind).select(
        "file_path", "source_path", "seq_id", loc.envelope(F.col("location")).alias("location"), loc.values_of(q, key).alias("classes"), F.lit(None).cast("string").alias("nt_seq"), on_edge.alias("on_contig_edge"), loc.other_qualifiers(q, *rest).alias("other_qualifiers")
    )
    return d.where(F.size("classes") > 0)


def contained(outer: DataFrame, inner: DataFrame, keys: list[str], start: str, end: str, bin_size: int | None = None) -> DataFrame:
    """Pairs (outer columns prefixed ``o_``, inner ``i_``) with equal keys and the inner span inside the outer one.

    ``bin_size`` cuts long contigs: an outer row is repeated for each bin that it touches and an inner row goes to the
    bin of its start, so each pair meets once and a hot contig is dealt to many tasks.
    """
    o = outer.select(*(F.col(c).alias(f"o_{c}") for c in outer.columns))
    i = inner.select(*(F.col(c).alias(f"i_{c}") for c in inner.columns))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"o_{k}") == F.col(f"i_{k}"))
    inside = (F.col(f"o_{start}") <= F.col(f"i_{start}")) & (F.col(f"o_{end}") >= F.col(f"i_{end}"))
    if bin_size:
        div = lambda c: F.floor(F.col(c) / bin_size)
        o = o.withColumn("_bin", F.explode(F.sequence(div(f"o_{start}"), F.greatest(div(f"o_{start}"), div(f"o_{end}")))))
        i = i.withColumn("_ibin", div(f"i_{start}"))
        return o.join(i, on & (F.col("_bin") == F.col("_ibin")) & inside).drop("_bin", "_ibin")
    return o.join(i, on & inside)


def with_contig(features: DataFrame, contigs: DataFrame) -> DataFrame:
    """Features with ``_contig`` (null if unknown) and ``_contig_length``."""
    c = contigs.select(F.col("file_path").alias("_path"), F.col("seq_id").alias("_seq"), F.col("sequence").alias("_contig"), F.col("length").alias("_contig_length"))
    return features.join(c, (F.col("source_path") == F.col("_path")) & (F.col("seq_id") == F.col("_seq")), "left").drop("_path", "_seq")


def span(contig: Column, location: Column) -> Column:
    return slice_strand(contig, location["start"], location["end"], location["strand"])


def translate_cds(cds: DataFrame, contigs: DataFrame, translate_all: bool = False, default_table: int | None = None) -> DataFrame:
    """Fills missing amino acid sequences (all of them if ``translate_all``) from the contigs."""
    table = F.coalesce("transl_table", F.lit(default_table)) if default_table is not None else F.col("transl_table")
    made = translate(span(F.col("_contig"), F.col("location")), table)
    d = with_contig(cds, contigs)
    value = F.coalesce(made, F.col("aa_sequence")) if translate_all else F.coalesce(F.col("aa_sequence"), made)
    return d.withColumn("aa_sequence", value).select(*cds.columns)


def fill_clusters(clusters: DataFrame, contigs: DataFrame, check_edges: bool = False) -> DataFrame:
    """Nucleotide sequences of the clusters; with ``check_edges``, whether they reach the contig's end."""
    d = with_contig(clusters, contigs).withColumn("nt_seq", F.coalesce(span(F.col("_contig"), F.col("location")), "nt_seq"))
    if check_edges:
        d = d.withColumn("on_contig_edge", F.coalesce(F.col("_contig_length") <= F.col("location.end"), "on_contig_edge"))
    return d.select(*clusters.columns)
