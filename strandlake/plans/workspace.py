"""A folder as a database of named typed tables with JSON facts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import files
from ..table import TypedTable

FACTS = "_workspace.json"


class Workspace:
    """Subclasses list their tables and fill them in ``build``."""

    tables: dict[str, type[TypedTable]] = {}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.facts: dict = {}

    def build(self, **inputs) -> None:
        raise NotImplementedError

    @classmethod
    def create(cls, spark: SparkSession, path: str, **inputs) -> Workspace:
        if files.exists(spark, path):
            raise FileExistsError(path)
        self = cls(spark, path)
        files.make_dirs(spark, f"{self.path}/data")
        self.build(**inputs)
        self.save_facts()
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Workspace:
        text = files.read_text(spark, f"{path.rstrip('/')}/{FACTS}")
        if text is None:
            raise FileNotFoundError(path)
        facts = json.loads(text)
        if facts.get("class_name") != cls.__name__:
            raise TypeError(f"{path} is a {facts.get('class_name')}, not a {cls.__name__}")
        self = cls(spark, path)
        self.facts = facts["facts"]
        return self

    @classmethod
    def get_or_create(cls, spark: SparkSession, path: str, **inputs) -> Workspace:
        return cls.load(spark, path) if files.exists(spark, f"{path.rstrip('/')}/{FACTS}") else cls.create(spark, path, **inputs)

    def save_facts(self) -> None:
        files.write_text(self.spark, f"{self.path}/{FACTS}", json.dumps({"class_name": type(self).__name__, "facts": self.facts}))

    def put(self, name: str, table: TypedTable) -> TypedTable:
        """Writes a table and returns it as read back, so that its idx is fixed."""
        table.write(f"{self.path}/data/{name}", overwrite=True)
        return self.get(name)

    def get(self, name: str) -> TypedTable:
        if name not in self.tables:
            raise KeyError(name)
        return self.tables[name].read(self.spark, f"{self.path}/data/{name}")

    @staticmethod
    def mark_of(df: DataFrame) -> str:
        """Equal for equal rows in any order: what a cached result was made from."""
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)"))).first()
        return f"{r[0]}:{r[1]}"

    def cached(self, kind: str, make: Callable[[], DataFrame], **parameters) -> DataFrame:
        """The Parquet of this kind and these parameters; made and written if it is not there."""
        key = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]
        path = f"{self.path}/cache/{kind}-{key}"
        if not files.exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
