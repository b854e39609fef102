"""Column expressions: sequences, locations and qualifiers, vectors, variants; ``register`` offers them to SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SQL = {
    "gc_percent(seq STRING) RETURNS DOUBLE": "regexp_count(seq, '[GCgc]') * 100.0D / nullif(regexp_count(seq, '[ACGTacgt]'), 0)",
    "mean_quality(qual STRING) RETURNS DOUBLE": "aggregate(transform(split(qual, ''), c -> ascii(c)), 0D, (a, x) -> a + x) / nullif(length(qual), 0) - 33",
    "n_count(seq STRING) RETURNS INT": "regexp_count(seq, 'N')",
    "mask_n(seq STRING) RETURNS STRING": "regexp_replace(seq, '[^AGCT]+', 'N')",
    "reverse_complement(seq STRING) RETURNS STRING": "reverse(translate(seq, 'ATGCatgc', 'TACGtacg'))",
    "kmers(seq STRING, k INT) RETURNS ARRAY<STRING>": (
        "array_sort(array_distinct(zip_with(regexp_extract_all(upper(seq), concat('(?=([ACGT]{', k, '}))'), 1),"
        " reverse(regexp_extract_all(reverse(translate(upper(seq), 'ATGC', 'TACG')), concat('(?=([ACGT]{', k, '}))'), 1)), (x, y) -> greatest(x, y))))"
    ),
    "sparse_distance(a MAP<STRING, DOUBLE>, b MAP<STRING, DOUBLE>) RETURNS DOUBLE": (
        "sqrt(aggregate(map_values(map_zip_with(a, b, (k, x, y) -> (coalesce(x, 0D) - coalesce(y, 0D)) * (coalesce(x, 0D) - coalesce(y, 0D)))), 0D, (s, x) -> s + x))"
    ),
    "nearest_key(v MAP<STRING, DOUBLE>, centres MAP<STRING, MAP<STRING, DOUBLE>>) RETURNS STRING": (
        "element_at(array_sort(transform(map_entries(centres), c -> struct(aggregate(map_values(map_zip_with(v, c.value,"
        " (k, x, y) -> (coalesce(x, 0D) - coalesce(y, 0D)) * (coalesce(x, 0D) - coalesce(y, 0D)))), 0D, (s, x) -> s + x) AS d, c.key AS k))), 1).k"
    ),
    "l2_normalize(v MAP<STRING, DOUBLE>) RETURNS MAP<STRING, DOUBLE>": "transform_values(v, (k, x) -> try_divide(x, sqrt(aggregate(map_values(v), 0D, (a, y) -> a + y * y))))",
    "vec_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": (
        "CASE WHEN a IS NULL OR b IS NULL OR size(a) = 0 OR size(a) <> size(b) THEN 0D"
        " WHEN aggregate(zip_with(a, b, (x, y) -> x * x + y * y), 0D, (s, x) -> s + x) = 0 THEN 0D"
        " ELSE coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x),"
        " sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), double('NaN')) END"
    ),
    "vec_euclid(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": (
        "CASE WHEN a IS NULL OR b IS NULL OR size(a) = 0 OR size(a) <> size(b) THEN 0D"
        " ELSE 1 - sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)) END"
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Registers temporary SQL functions in the session; returns their names."""
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.partition("(")[0] for head in _SQL]
