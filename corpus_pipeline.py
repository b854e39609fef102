"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing, one after the other over ``documents``.

Nulls and empty texts go at the quality rules (they have fewer words than these ask for); a null doc_id is judged like any
other. Rows that repeat are one document to line dedup and near-dedup, which keep or drop them together; the mix repeats rows,
and packing packs each on its own. Ties are broken by the smallest doc_id, in the mix by the key, then the doc_id. Long texts
pass whole. Extra columns, whatever their names, are kept up to the last stage, which returns its own. An empty table gives an
empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from strandlake.llm.common import documents, shared_dir

#: (name, function of spark, docs, sf_dir); each stage's result is written and read again as the next one's docs.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Shingle hashes, keyed sampling and the tokenizer are outside SQL; tests/llm/test_pipeline.py holds
#: what each stage makes of its input within run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
