"""Sequencing reads: FASTQ, FASTA and SAM scans into ``id, name, seq, plus, qual`` tables, their writers, and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.seq import pair_name
from ..functions.variant import rs_number
from ..schema import READS


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of whole files, plain or ``.gz``: a file is one task, so split large ones beforehand, or use
    :func:`fastq_lines` on one record a line."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")
    whole = whole.select(lines.alias("l"), F.col("_metadata.file_path").alias("f")).where(F.size("l") >= 4)
    whole = whole.select("f", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("l") / 4).cast("int") - 1), lambda i: F.slice("l", i * 4 + 1, F.lit(4)))).alias("n", "r"))
    return whole.select(F.xxhash64("f", "n").alias("id"), F.get("r", F.lit(0)).alias("name"), F.get("r", F.lit(1)).alias("seq"), F.get("r", F.lit(2)).alias("plus"), F.get("r", F.lit(3)).alias("qual"))


def fastq_split(spark: SparkSession, path: str) -> DataFrame:
    """The same records from plain files that are read in parts, whatever their size.

    Lines are numbered within each part (its file and the offset at which it starts), the parts' counts give the number at
    which each starts in its file, and every four lines meet as one record.
    """
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"), F.regexp_replace("value", "\r$", "").alias("line"))
    counts = d.groupBy("f", "b").agg(F.count(F.lit(1)).alias("lines"), F.min("m").alias("first"))
    # a part is one task's run of lines, so its numbers ascend without gaps
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("f").alias("_f"), F.col("b").alias("_b"), (before - F.col("first")).alias("_shift"))
    n = F.col("m") + F.col("_shift")
    r = d.join(starts, (F.col("f") == F.col("_f")) & (F.col("b") == F.col("_b"))).select("f", F.floor(n / 4).alias("n"), (n % 4).alias("i"), "line")
    one = lambda i: F.max(F.when(F.col("i") == i, F.col("line")))
    r = r.groupBy("f", "n").agg(one(0).alias("name"), one(1).alias("seq"), one(2).alias("plus"), one(3).alias("qual")).where("qual is not null")
    return r.select(F.xxhash64("f", "n").alias("id"), "name", "seq", "plus", "qual")


def convert(spark: SparkSession, read1: str, output: str, read2: str | None = None, to: str = "pq", overwrite: bool = False, join_pairs: bool = False, sort: str | None = None) -> None:
    """FASTQ files (or pairs of files) as Parquet (``pq``, sorted if asked), records a line (``lines``), or FASTA (``fa``)."""
    d = load(spark, read1, read2, join_pairs=join_pairs)
    if to == "pq":
        save(d, output, sort, overwrite)
    elif to == "lines":
        write_fastq_lines(d if "plus" in d.columns else d.withColumn("plus", F.lit("+")), output, overwrite)
    elif to == "fa":
        write_fasta(d.withColumn("name", F.regexp_replace("name", "^@", "")), output, overwrite)
    else:
        raise NotImplementedError(to)


def fastq_lines(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated records, one a line (the output of :func:`write_fastq_lines`): splittable at any size."""
    c = F.split("value", "\t")
    d = spark.read.text(path).select(c.alias("c")).where(F.size("c") >= 4)
    return d.select(F.xxhash64("c").alias("id"), *(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("name", "seq", "plus", "qual"))))


def write_fastq_lines(reads: DataFrame, path: str, overwrite: bool = False) -> None:
    reads.select(F.concat_ws("\t", "name", "seq", F.coalesce("plus", F.lit("+")), "qual").alias("value")).write.mode("overwrite" if overwrite else "error").text(path)


def fasta_reads(spark: SparkSession, path: str) -> DataFrame:
    lines = F.split(F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", ""), "\n", 2)
    d = spark.read.text(path, lineSep="\n>").where(F.trim("value") != "").select(lines.alias("l"))
    d = d.select(F.get("l", F.lit(0)).alias("name"), F.regexp_replace(F.coalesce(F.get("l", F.lit(1)), F.lit("")), "\n", "").alias("seq"))
    return d.select(F.xxhash64("name", "seq").alias("id"), "name", "seq", F.lit(None).cast("string").alias("plus"), F.lit(None).cast("string").alias("qual"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Query names and sequences of the alignment lines."""
    d = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 10)
    return d.select(F.xxhash64("c").alias("id"), F.get("c", F.lit(0)).alias("name"), F.get("c", F.lit(9)).alias("seq"))


def merge_pairs(reads: DataFrame) -> DataFrame:
    """One row for each pair name: mates in the order of their names, joined by N (sequence) and B (quality)."""
    mates = F.array_sort(F.collect_list(F.struct("name", "seq", "qual")))
    d = reads.groupBy(pair_name(F.col("name")).alias("name")).agg(mates.alias("m"))
    seqs, quals = F.transform("m", lambda x: x["seq"]), F.transform("m", lambda x: x["qual"])
    return d.select(F.xxhash64("name").alias("id"), "name", F.concat_ws("N", seqs).alias("seq"), F.concat_ws("B", quals).alias("qual"))


def load(spark: SparkSession, read1: str, read2: str | None = None, format: str = "fq", max_reads: int = 0, join_pairs: bool = False) -> DataFrame:
    """Reads of one or two files (mates interleaved by name): ``fq``, ``fa`` or ``pq``."""
    scan = {"fq": fastq, "fa": fasta_reads, "pq": lambda s, p: s.read.parquet(p)}[format]
    d = scan(spark, read1)
    if read2:
        d = d.unionByName(scan(spark, read2), allowMissingColumns=True)
        d = merge_pairs(d) if join_pairs else d.orderBy("name")
    return d.limit(max_reads) if max_reads else d


def write_fastq(reads: DataFrame, path: str, overwrite: bool = False) -> None:
    name = F.when(F.col("name").startswith("@"), F.col("name")).otherwise(F.concat(F.lit("@"), "name"))
    lines = reads.orderBy("name").select(F.concat_ws("\n", name, "seq", F.lit("+"), "qual").alias("value"))
    lines.write.mode("overwrite" if overwrite else "error").text(path)


def write_fasta(reads: DataFrame, path: str, overwrite: bool = False) -> None:
    name = F.when(F.col("name").startswith(">"), F.col("name")).otherwise(F.concat(F.lit(">"), "name"))
    reads.select(F.concat_ws("\n", name, "seq").alias("value")).write.mode("overwrite" if overwrite else "error").text(path)


def save(df: DataFrame, path: str, sort: str | None = None, overwrite: bool = True) -> None:
    """Parquet, sorted within files of ranges of ``sort`` (smaller and prunable) if given."""
    df = df.repartitionByRange(sort).sortWithinPartitions(sort) if sort else df
    df.write.mode("overwrite" if overwrite else "error").parquet(path)


def write_tsv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "error").option("sep", "\t").option("header", True).csv(path)


def vertices(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "TSV":
        reader = spark.read.option("sep", "\t").option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    raise NotImplementedError(kind)


def gwas(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """An association catalog (tab-separated with header, JSON or Parquet): rows with a positive odds ratio.

    Missing places are read from ``chrN:P`` in the SNP column; chromosomes become 1..25.
    """
    if kind == "csv":
        d = spark.read.option("sep", "\t").option("header", True).csv(path)
    elif kind == "json":
        d = spark.read.json(path)
    elif kind in ("pq", "parquet"):
        d = spark.read.parquet(path)
    else:
        raise NotImplementedError(kind)
    return catalog(d)


def catalog(d: DataFrame) -> DataFrame:
    from ..functions.variant import chromosome_number

    c = lambda n: F.col(f"`{n}`")
    place = r"chr([\dXYM]+):(\d+)"
    chromosome = F.coalesce(F.nullif(F.trim(c("CHR_ID").cast("string")), F.lit("")), F.nullif(F.regexp_extract(c("SNPs"), place, 1), F.lit("")))
    position = F.coalesce(F.nullif(F.trim(c("CHR_POS").cast("string")), F.lit("")), F.nullif(F.regexp_extract(c("SNPs"), place, 2), F.lit("")))
    return d.select(
        rs_number(c("SNP_ID_CURRENT")).alias("ids"),
        c("rallele").cast("string").alias("alt"),
        c("OR or BETA").cast("string").try_cast("float").alias("OR"),
        chromosome_number(chromosome).alias("chromosome"),
        position.try_cast("long").alias("position"),
        c("DISEASE/TRAIT").cast("string").alias("trait"),
        c("DATE ADDED TO CATALOG").cast("string").try_cast("date").alias("date"),
        c("PUBMEDID").cast("string").try_cast("long").alias("pubmedID"),
    ).where("OR > 0")


SCHEMA = READS
