"""Reads: k-mer counts, contamination, quality, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S


def kmer_counts(reads: DataFrame, k: int, least: int = 1, seq: str = "seq", windows: int = 1) -> DataFrame:
    """kmer, kmer_count: in how many reads each canonical k-mer (or minimizer code, if ``windows`` > 1) occurs."""
    many = lambda d: d.where(F.col("kmer_count") >= least) if least > 1 else d
    if windows <= 1 and k <= 31:  # numbers are counted, strings made of those that are left
        packed = S.kmer_codes(reads, seq, k).groupBy("code").agg(F.count(F.lit(1)).alias("kmer_count"))
        return S.kmer_strings(many(packed), k)
    codes = S.distinct_kmers(F.col(seq), k) if windows <= 1 else S.minimizers(F.col(seq), k, windows)
    return many(reads.select(F.explode(codes).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("kmer_count")))


def contaminated(reads: DataFrame, reference: DataFrame, k: int = 31, least: int = 0, id_: str = "id", seq: str = "seq", minimizer: bool = False) -> DataFrame:
    """The distinct ids of reads that share a k-mer with the reference (one that occurs in ``least`` reference rows)."""
    m = k // 2 + 1
    if not minimizer and k <= 31:
        # the id goes along with each code; a reference k-mer counts once a row
        ref = S.kmer_codes(reference, seq, k).groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(1, least)).select(F.col("code").alias("kmer"))
        codes = reads.select(id_, F.explode(S.packed_kmers(F.col(seq), k)).alias("kmer"))
    else:
        of = (lambda: S.minimizers(F.col(seq), m, max(k - m, 1))) if minimizer else (lambda: S.distinct_kmers(F.col(seq), k))
        ref = reference.select(F.explode(of()).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(1, least)).select("kmer")
        codes = reads.select(id_, F.explode(of()).alias("kmer"))
    return codes.join(ref, "kmer", "left_semi").select(id_).distinct()


def contamination_filter(reads: DataFrame, reference: DataFrame, k: int = 31, least: int = 0, singletons: bool = True, minimizer: bool = False) -> DataFrame:
    """Reads that share no k-mer with the reference; without ``singletons`` a read goes with its removed mate."""
    clean = reads.join(contaminated(reads, reference, k, least, minimizer=minimizer), "id", "left_anti")
    return clean if singletons else surviving_pairs(clean)


def surviving_pairs(reads: DataFrame, name: str = "name") -> DataFrame:
    """Reads of pair names that occur more than once."""
    n = reads.groupBy(S.pair_name(F.col(name)).alias("_pair")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_pair")
    return reads.join(n, S.pair_name(F.col(name)) == F.col("_pair"), "left_semi")


def stats(reads: DataFrame, fraction: float | None = None, seed: int = 1234, replacement: bool = False) -> DataFrame:
    """id, gc, mean_quality, length, N_count of all reads or of a sample."""
    missing = {"id", "seq", "qual"} - set(reads.columns)
    if missing:
        raise ValueError(f"reads lack {sorted(missing)}")
    d = reads.sample(replacement, fraction, seed) if fraction is not None else reads
    return d.select("id", S.gc_percent(F.col("seq")).alias("gc"), S.mean_quality(F.col("qual")).alias("mean_quality"), F.length("seq").alias("length"), S.n_count(F.col("seq")).alias("N_count"))


def quality_filter(reads: DataFrame, max_ns: int = 2, least: float = 30) -> DataFrame:
    ns = F.col("N_count") if "N_count" in reads.columns else S.n_count(F.col("seq"))
    quality = F.col("mean_quality") if "mean_quality" in reads.columns else S.mean_quality(F.col("qual"))
    return reads.where((ns <= max_ns) & (quality >= least))


def mask(reads: DataFrame, seq: str = "seq") -> DataFrame:
    return reads.withColumn(seq, S.mask_n(F.col(seq)))


def histogram(values: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """bin (from 1), n: equal bins between two numbers."""
    return values.select(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def tally(results: DataFrame, status: str = "status") -> DataFrame:
    """(skipped, failed, succeeded) from -1, 0, 1, as one row."""
    return results.agg(F.count_if(F.col(status) == -1).alias("skipped"), F.count_if(F.col(status) == 0).alias("failed"), F.count_if(F.col(status) == 1).alias("succeeded"))
