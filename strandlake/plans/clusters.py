"""Gene clusters: tables, feature vectors, families (centroids) and membership."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import annotation as A
from ..operators import features as V
from ..table import Cds, Clusters, Nucleotides, Relation, TypedTable
from .workspace import Workspace


def profile_names(hmm_text: str) -> list[str]:
    """Sorted accession numbers of a profile file's text (names where a profile has none)."""
    out = []
    for block in hmm_text.split("//"):
        m = re.search(r"^ACC\s+(\S+)", block, re.M) or re.search(r"^NAME\s+(\S+)", block, re.M)
        if m:
            out.append(m[1])
    return sorted(out)


def gathering_cutoffs(hmm_text: str) -> list[tuple[str, float]]:
    """(accession, gathering score) of a profile file's text."""
    out = []
    for block in hmm_text.split("//"):
        acc, ga = re.search(r"^ACC\s+(\S+)", block, re.M), re.search(r"^GA\s+([-\d.]+)", block, re.M)
        if acc and ga:
            out.append((acc[1], float(ga[1])))
    return out


def split_subfamily(name):
    """(core, number) of ``core.aligned_cN``."""
    return F.regexp_extract(name, r"^(.*)\.aligned_c\d+$", 1), F.regexp_extract(name, r"\.aligned_c(\d+)$", 1).try_cast("int")


class ClusterDatabase(Workspace):
    tables: dict[str, type[TypedTable]] = {"clusters": Clusters, "cds": Cds, "cds_to_cluster": Relation}

    def build(self, features: DataFrame, contigs: DataFrame | None = None, source: str = "antismash", **options) -> None:
        c = A.clusters_from_features(features, source, **options)
        d = A.cds_from_features(features)
        if contigs is not None:
            c, d = A.fill_clusters(c, contigs, check_edges=source == "smc"), A.translate_cds(d, contigs, default_table=11)
        clusters, cds = self.put("clusters", Clusters(c)), self.put("cds", Cds(d))
        flat = lambda t: t.df.select("idx", "source_path", "seq_id", F.col("location.start").alias("start"), F.col("location.end").alias("end"))
        pairs = A.contained(flat(clusters), flat(cds), ["source_path", "seq_id"], "start", "end")
        self.put("cds_to_cluster", Relation(pairs.select(F.col("i_idx").alias("idx_1"), F.col("o_idx").alias("idx_2"))))
        self.facts["source"] = source

    def members(self) -> DataFrame:
        return self.get("cds_to_cluster").df.select(F.col("idx_1").alias("cds_id"), F.col("idx_2").alias("bgc_id"))

    def vectors(self, hits: DataFrame, sub_hits: DataFrame | None = None, top_k: int = 3, cutoffs: DataFrame | None = None, sub_bitscore: float = 20.0) -> DataFrame:
        """bgc_id, features from domain hits (cds_id, hmm_acc, bitscore) and sub-family hits (cds_id, hmm_name, bitscore)."""
        m = self.members()
        good = V.cutoff_hits(hits, cutoffs) if cutoffs is not None else hits
        parts = [V.domain_features(good, m)]
        if sub_hits is not None:
            core, _ = split_subfamily(F.col("hmm_name"))
            ranked = V.ranked_features(V.cutoff_hits(sub_hits, bitscore=sub_bitscore).withColumn("core", core), ["cds_id"], "core", "hmm_name", top_k)
            parts.append(ranked.join(m, "cds_id").select("bgc_id", F.col("hmm_name").alias("key"), "value"))
        return V.vectors(*parts)

    def families(self, vectors: DataFrame, threshold: float = 0.4, parts: int = 8, tag: str = "") -> DataFrame:
        return self.cached("centroids", lambda: V.centroids(vectors, threshold, parts), threshold=threshold, parts=parts, tag=tag, rows=self.mark_of(vectors))

    def membership(self, vectors: DataFrame, threshold: float = 0.4, parts: int = 8, tag: str = "") -> DataFrame:
        centres = self.families(vectors, threshold, parts, tag)
        return self.cached("membership", lambda: V.nearest(vectors, centres), threshold=threshold, parts=parts, tag=tag, rows=self.mark_of(vectors))


class GenomeDatabase(Workspace):
    """Contigs and their coding sequences."""

    tables: dict[str, type[TypedTable]] = {"contigs": Nucleotides, "cds": Cds}

    def build(self, contigs: TypedTable, features: DataFrame) -> None:
        self.put("contigs", contigs)
        self.put("cds", Cds(A.cds_from_features(features)))

    def count_cds(self) -> DataFrame:
        return self.get("cds").df.groupBy("source_path").count()


def scan_domains(cds: DataFrame, scorer: Callable[[], Callable[[str], list[tuple]]]) -> DataFrame:
    """Hits of a pluggable scorer: ``scorer()`` is called once a task (it loads the profiles) and returns a function from an
    amino acid sequence to (from, to, accession, name, bitscore) tuples."""
    from ..schema import HITS

    def run(batches):
        import pandas as pd

        score = scorer()
        for pdf in batches:
            rows = [(i, *hit) for i, s in zip(pdf.idx, pdf.aa_sequence, strict=True) if s for hit in score(s)]
            yield pd.DataFrame(rows, columns=["cds_id", "cds_from", "cds_to", "hmm_acc", "hmm_name", "bitscore"])

    return cds.select("idx", "aa_sequence").mapInPandas(run, HITS)
