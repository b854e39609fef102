"""Paths of any scheme, through Hadoop's file systems."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

_FORBIDDEN = re.compile(r"[#<>$+%!&*'|{?\"=}@]")


def parse(path: str) -> tuple[str, str]:
    """(scheme, path): ``s3://b/x`` -> ``s3``; no scheme -> ``file``. Characters that break globs or URIs are refused."""
    m = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):(?=/)", path)
    rest = path[m.end() :] if m else path
    if _FORBIDDEN.search(rest) or ":" in rest:
        raise ValueError(f"not a path: {path}")
    return (m[1].lower() if m else "file"), rest


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def make_dirs(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Puts ``new`` in the place of ``path``; what was there is moved aside first and deleted last, so a crash loses neither."""
    fs, p = _fs(spark, path)
    if p.getParent() is not None:
        fs.mkdirs(p.getParent())
    aside = _fs(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex}.old")[1]
    had = fs.exists(p)
    if had and not fs.rename(p, aside):
        raise OSError(f"cannot rename {path}")
    if not fs.rename(_fs(spark, new)[1], p):
        if had:
            fs.rename(aside, p)
        raise OSError(f"cannot rename {new} to {path}")
    if had:
        fs.delete(aside, True)


def copy(spark: SparkSession, source: str, target: str) -> None:
    a, p = _fs(spark, source)
    b, q = _fs(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])
