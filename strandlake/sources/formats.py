"""Formats whose parsing is column expressions: FASTA, GFF3, VCF, delimited pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import loc
from ..table import Features, Metadata, Nucleotides, Proteins, Variants
from .base import Format


class Fasta(Format):
    delimiter = "\n>"

    def __init__(self, kind: str = "nucl"):
        if kind not in ("nucl", "prot"):
            raise TypeError(f"nucl or prot, not {kind}")
        self.table = Nucleotides if kind == "nucl" else Proteins

    def parse(self, records: DataFrame) -> DataFrame:
        lines = F.split(F.regexp_replace(F.regexp_replace("record", "\r", ""), "^>", ""), "\n", 2)
        head, body = F.get(lines, F.lit(0)), F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
        sequence = F.regexp_replace(body, "[\n ]", "")
        return records.select(
            "file_path",
            F.regexp_extract(head, r"^\s*(\S*)", 1).alias("seq_id"),
            F.regexp_extract(head, r"^\s*\S+ (.*)$", 1).alias("desc"),
            sequence.alias("sequence"),
            F.length(sequence).cast("long").alias("length"),
        )


class Pairs(Format):
    """``key,value`` lines."""

    delimiter, table = "\n", Metadata

    def parse(self, records: DataFrame) -> DataFrame:
        p = F.split("record", ",", 2)
        return records.select("file_path", F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).alias("value"))


class Gff3(Format):
    """One feature for each line of nine columns; percent-escapes are decoded if ``decode``."""

    delimiter, table = "\n", Features

    def __init__(self, source_path: Callable | None = None, decode: bool = False):
        self.source_path, self.decode = source_path, decode

    def parse(self, records: DataFrame) -> DataFrame:
        d = records.where(~F.col("record").startswith("#")).select("file_path", F.split(F.regexp_replace("record", "\r$", ""), "\t").alias("c")).where(F.size("c") == 9)
        text = lambda x: F.try_url_decode(F.regexp_replace(x, r"\+", "%2B")) if self.decode else x
        pairs = F.filter(F.split(F.get("c", F.lit(8)), ";"), lambda p: F.trim(p) != "")
        pairs = F.transform(pairs, lambda p: F.struct(F.trim(F.get(F.split(p, "=", 2), F.lit(0))).alias("key"), F.transform(F.split(F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit("")), ","), text).alias("values")))
        keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
        # a key that occurs again adds its values
        merged = F.transform(keys, lambda k: F.struct(k.alias("key"), F.flatten(F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["values"])).alias("values")))
        source = F.struct(F.lit("gff3-source-column").alias("key"), F.array(F.get("c", F.lit(1))).alias("values"))
        place = F.struct(F.get("c", F.lit(3)).try_cast("long").alias("start"), F.get("c", F.lit(4)).try_cast("long").alias("end"), F.lit(False).alias("start_partial"), F.lit(False).alias("end_partial"), loc.strand_of(F.get("c", F.lit(6))).alias("strand"))
        return d.select("file_path", F.get("c", F.lit(0)).alias("seq_id"), F.get("c", F.lit(2)).alias("type"), F.array(place).alias("location"), F.concat(merged, F.array(source)).alias("qualifiers"))

    def finish(self, df: DataFrame) -> DataFrame:
        if self.source_path is None:
            return df.withColumn("source_path", F.regexp_replace("file_path", r"\.gff(?!.*\.gff)", ".fna"))
        return df.withColumn("source_path", F.udf(self.source_path, "string")("file_path"))


class VcfHeader(Format):
    """``##key=value`` lines, and the sample names as the tab-joined value of ``samples``."""

    delimiter, table = "\n", Metadata

    def parse(self, records: DataFrame) -> DataFrame:
        line = F.regexp_replace("record", "\r$", "")
        pair = F.split(F.substring(line, 3, 1 << 30), "=", 2)
        d = records.where(F.col("record").startswith("#"))
        names = F.when(F.contains(line, F.lit("\tFORMAT\t")), F.substring_index(line, "\tFORMAT\t", -1)).otherwise(F.lit(""))
        header = line.startswith("#CHROM")
        return d.where(F.col("record").startswith("##") | F.col("record").startswith("#CHROM")).select(
            "file_path", F.when(header, F.lit("samples")).otherwise(F.get(pair, F.lit(0))).alias("key"), F.when(header, names).otherwise(F.get(pair, F.lit(1))).alias("value")
        )


class Vcf(Format):
    delimiter, table = "\n", Variants

    def parse(self, records: DataFrame) -> DataFrame:
        d = records.where(~F.col("record").startswith("#")).select("file_path", F.split(F.regexp_replace("record", "\r$", ""), "\t").alias("c"))
        names = ["chromosome", "position", "ids", "references", "alts", "qual", "filter", "info", "format"]
        samples = F.when(F.size("c") > 9, F.slice("c", F.lit(10), F.size("c") - 9)).otherwise(F.array().cast("array<string>"))
        return d.select("file_path", *(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)), samples.alias("samples"))
