"""Record-delimited text formats: one class for each format, four ways to load it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import files
from ..table import TypedTable

#: Beside the Parquet of a big load: the files that it was made from, those without rows too.
LISTED = "_strandlake_files"
#: Separates the files in a concatenation.
MARK = "\n>>>>>file_path:"


class Format:
    """``delimiter`` ends or separates records; ``parse`` turns (file_path, record) rows into the table's columns.

    Parsers that can fail set ``error`` to a message, null for good rows; loading then fails, or drops such rows when
    ``skip_malformed`` is set. Formats that are plain expressions have nothing to fail on.
    """

    delimiter: str
    table: type[TypedTable]

    def parse(self, records: DataFrame) -> DataFrame:
        raise NotImplementedError

    def finish(self, df: DataFrame) -> DataFrame:
        return df

    def _table(self, records: DataFrame, skip_malformed: bool) -> TypedTable:
        rows = self.parse(records.where(F.trim("record") != ""))
        if "error" in rows.columns:
            if skip_malformed:
                rows = rows.where(F.col("error").isNull())
            else:
                failed = F.raise_error(F.concat(F.lit("Failed when parsing a record in "), F.col("file_path"), F.lit(": "), F.col("error")))
                rows = rows.withColumn("file_path", F.when(F.col("error").isNotNull(), failed.cast("string")).otherwise(F.col("file_path")))
            rows = rows.drop("error")
        return self.table(self.finish(rows))

    def _split(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        # each listing of a path counts, so a file given twice is read twice
        parts = {}
        for p in paths:
            parts[p] = parts.get(p, 0) + 1
        out = None
        for times in sorted(set(parts.values())):
            df = spark.read.text([p for p, n in parts.items() if n == times], lineSep=self.delimiter)
            df = df.select(path_of().alias("file_path"), F.col("value").alias("record"))
            df = df.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_n") if times > 1 else df
            out = df if out is None else out.unionByName(df)
        return out

    def load_small(self, spark: SparkSession, pattern: str, min_partitions: int | None = None, skip_malformed: bool = False) -> TypedTable:
        """Files of a glob."""
        if not isinstance(pattern, str):
            raise TypeError("the file pattern must be a string")
        df = self._split(spark, [pattern])
        return self._table(df.repartition(min_partitions) if min_partitions else df, skip_malformed)

    def load_listed(self, spark: SparkSession, list_path: str, skip_malformed: bool = False) -> TypedTable:
        """Files named, one a line, by a text file."""
        paths = [p.strip() for p in (files.read_text(spark, list_path) or "").splitlines() if p.strip()]
        return self._table(self._split(spark, paths), skip_malformed)

    def load_big(self, spark: SparkSession, paths: list[str], intermediate: str | None = None, skip_malformed: bool = False) -> TypedTable:
        """Named files in one splittable scan; kept as Parquet under ``intermediate`` if given, and taken from there if it
        holds just these files."""
        for p in paths:
            if not files.exists(spark, p) or files.is_directory(spark, p):
                raise FileNotFoundError(p)
        listed = "\n".join(sorted(map(normal, paths)))
        if intermediate and files.exists(spark, intermediate):
            df = spark.read.schema(self.table.schema()).parquet(intermediate)
            if files.read_text(spark, f"{intermediate}/{LISTED}") != listed:
                raise FileExistsError(f"{intermediate} holds other files")
            return self.table(df, keep_idx=True)
        out = self._table(self._split(spark, list(paths)), skip_malformed)
        if intermediate:
            out.df.write.parquet(intermediate)
            files.write_text(spark, f"{intermediate}/{LISTED}", listed)
            out = self.table(spark.read.schema(self.table.schema()).parquet(intermediate), keep_idx=True)
        return out

    def load_concatenated(self, spark: SparkSession, pattern: str, skip_malformed: bool = False) -> TypedTable:
        """The output of :func:`concatenate`, with the original paths."""
        whole = spark.read.text(pattern, lineSep=MARK).where(F.trim("value") != "")
        parts = F.split("value", "\n", 2)
        body = whole.select(F.get(parts, F.lit(0)).alias("file_path"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("body"))
        return self._table(body.select("file_path", F.explode(F.split("body", literal(self.delimiter))).alias("record")), skip_malformed)


def literal(s: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != "\n" else c for c in s)


def path_of() -> Column:
    """The file's path without ``file:`` in every load mode."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:(?://)?(?=/)", "")


def normal(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def concatenate(spark: SparkSession, pattern: str, output: str, partitions: int | None = None) -> None:
    """Many small files into few text files, each file once, led by its path."""
    df = spark.read.text(pattern, wholetext=True).select(path_of().alias("path"), "value").dropDuplicates(["path"])
    df = df.repartition(partitions) if partitions else df
    df.select(F.concat(F.lit(MARK), "path", F.lit("\n"), "value").alias("value")).write.text(output)
