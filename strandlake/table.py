"""Typed tables: a DataFrame with a fixed schema, an ``idx`` key, lineage ids, a validity rule and a Parquet envelope."""

from __future__ import annotations

import json
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files
from .functions import seq
from .schema import COLUMNS, same, struct


class TypedTable:
    """Subclasses give the columns after ``idx`` (and ``file_path`` if ``from_files``) and the validity rule."""

    columns_key: str
    from_files = True

    def __init__(self, df: DataFrame, override_idx: bool = False, keep_idx: bool = False, sources: list[str] | None = None, key: list[str] | None = None):
        """``df`` without ``idx``: one is made, by hashing the columns ``key`` if given (stable), otherwise unique but not
        stable under recomputation. With ``idx``: say whether to keep or to override it (keeping wins)."""
        if "idx" in df.columns and not keep_idx:
            if not override_idx:
                raise ValueError("the table has an idx column already: set keep_idx or override_idx")
            df = df.drop("idx")
        if "idx" not in df.columns:
            df = df.withColumn("idx", F.xxhash64(*key) if key else F.monotonically_increasing_id())
        want = self.schema()
        df = df.select(*(F.col(f"`{n}`") for n in want.fieldNames()))
        if not same(df.schema, want):
            raise AttributeError(f"{type(self).__name__} needs {want.simpleString()}, not {df.schema.simpleString()}")
        self._df = df
        self.sources = list(sources or [])
        self._renew()

    def _renew(self) -> None:
        self.id = f"{type(self).__name__}#{uuid.uuid4().hex}"

    @classmethod
    def schema(cls) -> T.StructType:
        return struct("idx BIGINT, " + ("file_path STRING, " if cls.from_files else "") + COLUMNS[cls.columns_key])

    @property
    def df(self) -> DataFrame:
        return self._df

    @df.setter
    def df(self, df: DataFrame) -> None:
        self._df = df.select(*(F.col(f"`{n}`") for n in self.schema().fieldNames()))
        self._renew()

    @df.deleter
    def df(self) -> None:
        self._df = None

    def update_sources(self, *tables: TypedTable) -> None:
        self.update_source_ids(*(t.id for t in tables))

    def update_source_ids(self, *ids: str) -> None:
        self.sources = list(dict.fromkeys([*self.sources, *ids]))

    @classmethod
    def valid(cls) -> Column:
        return F.lit(True)

    @classmethod
    def _valid(cls) -> Column:
        return F.coalesce(cls.valid(), F.lit(False))

    def valids(self) -> TypedTable:
        return type(self)(self.df.where(self._valid()), keep_idx=True, sources=[self.id])

    def invalids(self) -> TypedTable:
        return type(self)(self.df.where(~self._valid()), keep_idx=True, sources=[self.id])

    def count_valids(self) -> tuple[int, int]:
        r = self.df.agg(F.count_if(self._valid()).alias("a"), F.count_if(~self._valid()).alias("b")).first()
        return r.a, r.b

    def write(self, path: str, overwrite: bool = False, partitions: int | None = None) -> None:
        """Parquet and a sidecar with id, sources, class and schema. Overwriting is skipped if the path holds this id, and
        goes through a second folder, so a table can overwrite what it was read from."""
        spark = self.df.sparkSession
        if files.exists(spark, path):
            if not overwrite:
                raise FileExistsError(path)
            if (self._envelope(spark, path) or {}).get("id") == self.id:
                return
        df = self.df.repartition(partitions) if partitions else self.df
        new = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new"
        df.write.parquet(new)
        files.write_text(spark, f"{new}/{SIDECAR}", json.dumps({"id": self.id, "source_ids": self.sources, "class_name": type(self).__name__, "schema": self.schema().simpleString()}))
        files.replace(spark, new, path)

    @staticmethod
    def _envelope(spark: SparkSession, path: str) -> dict | None:
        text = files.read_text(spark, f"{path}/{SIDECAR}")
        return json.loads(text) if text else None

    @classmethod
    def read(cls, spark: SparkSession, path: str, partitions: int | None = None) -> TypedTable:
        if not files.exists(spark, path):
            raise FileNotFoundError(path)
        facts = cls._envelope(spark, path)
        if facts is None:
            warnings.warn(f"{path} has no sidecar; its class is not checked", stacklevel=2)
        elif facts["class_name"] != cls.__name__:
            raise TypeError(f"{path} holds a {facts['class_name']}, not a {cls.__name__}")
        elif facts["schema"] != cls.schema().simpleString():
            raise TypeError(f"{path} has the schema {facts['schema']}")
        df = spark.read.schema(cls.schema()).parquet(path)
        out = cls(df.repartition(partitions) if partitions else df, keep_idx=True)
        if facts:
            out.id, out.sources = facts["id"], facts["source_ids"]
        return out


SIDECAR = "_strandlake.json"


class Metadata(TypedTable):
    columns_key = "metadata"

    @classmethod
    def valid(cls):
        return F.col("value").isNotNull()


class Relation(TypedTable):
    columns_key, from_files = "relation", False

    @classmethod
    def valid(cls):
        return F.col("idx_1").isNotNull() & F.col("idx_2").isNotNull()


class Sequences(TypedTable):
    columns_key, pattern = "sequence", seq.NUCLEOTIDE

    @classmethod
    def valid(cls):
        return F.col("sequence").rlike(cls.pattern) & (F.length("sequence") == F.col("length")) & (F.col("length") > 0)


class Nucleotides(Sequences):
    pass


class Proteins(Sequences):
    pattern = seq.PROTEIN


class Reads(Sequences):
    columns_key = "read"

    @classmethod
    def valid(cls):
        return super().valid() & (F.size("quality") == F.col("length"))


class PairedReads(Reads):
    """The mate may be empty."""

    columns_key = "paired_read"

    @classmethod
    def valid(cls):
        mate = F.col("sequence_2").rlike("^[ATGCNatgcn]*$") & (F.length("sequence_2") == F.col("length_2"))
        return super().valid() & mate & (F.size("quality_2") == F.col("length_2"))


class Features(TypedTable):
    columns_key = "feature"

    @classmethod
    def valid(cls):
        return F.size("location") > 0


class Cds(TypedTable):
    columns_key = "cds"

    @classmethod
    def valid(cls):
        return F.col("aa_sequence").isNotNull()


class Clusters(TypedTable):
    columns_key = "cluster"


class Variants(TypedTable):
    columns_key = "variant"
