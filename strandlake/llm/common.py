"""Pieces that several training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, or one beside its tables where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: cuts the lineage, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as Parquet: for wide rows of which later steps read some columns."""
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def within(small: DataFrame, rows: int) -> DataFrame:
    """``small``, marked for broadcasting if a count shows at most ``rows`` rows; otherwise Spark joins by shuffle."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, for helpers that must not clash with extra columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; none for null or blank ones."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def shl(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def shr(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)
