"""Runs an external tool over files, one task a file: ``python -m strandlake.runner MODULE GLOBS OUTDIR [PARAMS]``.

A module offers ``run_module(input, output, params) -> -1 | 0 | 1`` (skipped, failed, done) and ``show_help()``.
"""

from __future__ import annotations

import importlib
import os
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .. import files
from ..operators.reads import tally
from ..sources.base import normal


def run_files(spark: SparkSession, paths: list[str], output: str, task: Callable[[str, str, str], int], params: str = "") -> DataFrame:
    """path, status, message of every file, one task each; an exception counts as failed and gives its message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            status, message = [], []
            for p in pdf.path:
                try:
                    status.append(int(task(p, f"{output}/{os.path.basename(p)}", params)))
                    message.append(None)
                except Exception as e:  # a tool's failure is a result
                    status.append(0)
                    message.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": pdf.path, "status": status, "message": pd.Series(message, dtype=object)})

    listed = sorted(set(paths))
    df = spark.createDataFrame([(p,) for p in listed], "path string").repartition(max(1, len(listed)))
    return df.mapInPandas(run, "path string, status int, message string")


def command(argv: Callable[[str, str, str], list[str]], done: str | None = None) -> Callable[[str, str, str], int]:
    """A task that runs a program; skipped if ``done`` exists in the output folder."""

    def task(path: str, output: str, params: str) -> int:
        if done and os.path.exists(os.path.join(output, done)):
            return -1
        line = argv(path, output, params)
        if shutil.which(line[0]) is None:
            return 0
        return int(subprocess.run(line, check=False, capture_output=True).returncode == 0)

    return task


def main(args: list[str]) -> int:
    if len(args) < 3:
        print(__doc__)
        return 2
    module = importlib.import_module(args[0])
    builder = SparkSession.builder.appName("strandlake")
    if os.environ.get("STRANDLAKE_MASTER"):
        builder = builder.master(os.environ["STRANDLAKE_MASTER"])
    conf = os.environ.get("STRANDLAKE_CONF")
    if conf:
        for line in open(conf):
            key, _, value = line.rstrip("\n").partition("\t")
            if key:
                builder = builder.config(key, value)
    spark = builder.getOrCreate()
    paths = [p for pattern in args[1].split(",") for p in files.glob(spark, pattern)]
    results = run_files(spark, [normal(p) for p in paths], args[2], module.run_module, " ".join(args[3:]))
    r = tally(results).first()
    print(f"skipped {r.skipped}, failed {r.failed}, done {r.succeeded}")
    return int(r.failed > 0)
