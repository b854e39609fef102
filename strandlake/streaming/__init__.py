"""Files that arrive over time: the record-delimited formats as streams, and k-mer counts kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import kmers
from ..sources.base import Format, path_of


def read_stream(spark: SparkSession, fmt: Format, directory: str, files_per_trigger: int | None = None) -> DataFrame:
    """The columns that ``fmt`` parses, of every file that appears in a folder."""
    reader = spark.readStream.option("lineSep", fmt.delimiter)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    records = reader.text(directory).select(path_of().alias("file_path"), F.col("value").alias("record"))
    return fmt.parse(records.where(F.trim("record") != ""))


def kmer_counts(sequences: DataFrame, k: int) -> DataFrame:
    """Running counts of the sequences that hold each canonical k-mer (use output mode ``complete`` or ``update``)."""
    return sequences.select(F.explode(kmers(F.col("sequence"), k)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("kmer_count"))
