"""Operator 9: mixing sources to target weights by Efraimidis-Spirakis sampling (native).

The mix holds ``share`` of all words. Sources, in code point order with null last, weigh ``weights`` in turn; a source's
target stops at ``most`` times its size and the excess is shared again by weight among the others: target =
min(most * size, level * weight), and the level comes from one pass over the sources ordered by size over weight.

A source is taken in complete epochs first (every document as often as its target holds its size); what is left is a
budget that documents fill in the order of their keys u^(1/w), largest first, with u a hash of doc_id and text and w the
document's quality weight in [1, 2]. The document at the budget's end is taken up to the budget, so a source's taken
words miss its target by less than one.

A hot source is never sorted in one task: a key's place in [0, 1) gives one of ``ceil(documents / per_bin)`` bins, whose
load is at most twice the mean since w <= 2; sums of bins place the budget's end in one bin, and only that is sorted.

Nulls: a null text has size 0 and is never taken; null is a source of its own. Ties in the key go by doc_id, then by the
text's hash; whole repeated rows have equal keys and share what they get in any order. Documents or sources of size 0 have
target and taken 0. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, documents, fresh, within, words


@dataclass(frozen=True)
class Mix:
    share: float = 1.5
    weights: tuple[int, ...] = (3, 1, 2)
    most: float = 2.0
    per_bin: int = 20_000
    #: Sources up to this many are broadcast, after a count; more are joined by a shuffle.
    small: int = 100_000


def quality(text: Column) -> Column:
    """2 - the share of symbols and digits among the characters: junk has the least weight."""
    t = F.coalesce(text, F.lit(""))
    other = F.length(t) - F.length(F.translate(t, "#*$%&|<>=+_~^{}[]0123456789", ""))
    return 2.0 - F.coalesce(F.try_divide(other.cast("double"), F.length(t).cast("double")), F.lit(1.0))


def targets(sizes: DataFrame, p: Mix) -> DataFrame:
    """source, source_size, n, target; ``sizes``: source, source_size, n. One row a source, so one window holds them all."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in p.weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(p.weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", p.most * F.col("source_size"))
    everything = Window.partitionBy()
    s = s.withColumn("goal", p.share * F.sum("source_size").over(everything))
    # sources are capped in the order of cap / weight; the level is right if the next source is not capped by it
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("goal") - F.col("capped")) / F.col("open"))
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return s.select("source", "source_size", "n", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def taken(docs: DataFrame, params: Mix | None = None, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, key_hash; one row for each row of ``docs``.

    ``weight``: a number in [1, 2] of each document, :func:`quality` if not given.
    """
    p = params or Mix()
    t = F.coalesce(F.col("text"), F.lit(""))
    unit = (F.call_function("shiftrightunsigned", F.xxhash64("doc_id", t), F.lit(11)).cast("double") + 0.5) / F.lit(float(1 << 53))
    w = F.least(F.lit(2.0), F.greatest(F.lit(1.0), weight if weight is not None else quality(F.col("text"))))
    d = docs.select("doc_id", "source", F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"), F.pow(unit, 1 / w).alias("key"), F.xxhash64(t, F.col("doc_id")).alias("key_hash"))
    d = cut(d)
    # partial sums leave a row for each source and task, however hot a source is
    s = cut(targets(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), p))
    s = s.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    s = s.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")).withColumn("bins", F.ceil(F.col("n") / F.lit(p.per_bin)).cast("long"))
    side = s.withColumnRenamed("source", "_source")
    d = d.join(within(side, p.small), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    d = d.withColumn("bin", F.least(F.floor((1 - F.col("key")) * F.col("bins")), F.col("bins") - 1))
    ends = d.groupBy("source", "bin").agg(F.sum("size").alias("held"))
    ends = ends.withColumn("before", F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = ends.join(within(s.select(F.col("source").alias("_source"), "budget"), p.small), F.col("source").eqNullSafe(F.col("_source")))
    # the one bin of each source in which the budget ends
    ends = ends.where((F.col("before") < F.col("budget")) & (F.col("before") + F.col("held") >= F.col("budget"))).select("_source", F.col("bin").alias("end_bin"), "before")
    d = d.join(within(cut(ends), p.small), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    whole = F.col("epochs") * F.col("size")
    inside = F.coalesce(F.col("bin") == F.col("end_bin"), F.lit(False))
    clear = d.where(~inside).withColumn("taken", whole + F.when(F.coalesce(F.col("bin") < F.col("end_bin"), F.lit(False)), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source", "bin").orderBy(F.col("key").desc(), "doc_id", "key_hash").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    last = d.where(inside).withColumn("taken", whole + F.greatest(F.lit(0), F.least(F.col("size"), room)))
    return clear.unionByName(last).select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "key_hash")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each row as often as it is taken; what is taken in part is the text up to that many words.

    The rows of one document are told from others by doc_id and the text's hash, so repeated rows stay repeated.
    """
    key, part, n, size, own = fresh(docs, "_key", "_part", "_n", "_size", "_mine")
    mine = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id"))
    t = taken(docs).groupBy("key_hash").agg(F.sum("taken").alias(n), F.sum("size").alias(size), F.count(F.lit(1)).alias(part)).where(F.col(n) > 0)
    # equal rows share what they have been given evenly: rows of one key are the same text
    t = t.select(F.col("key_hash").alias(key), F.floor(F.col(n) / F.col(part)).alias(n), F.floor(F.col(size) / F.col(part)).alias(size))
    d = docs.withColumn(own, mine).join(t, F.col(own) == F.col(key)).drop(own, key)
    lengths = F.concat(F.array_repeat(F.col(size), F.floor(F.col(n) / F.col(size)).cast("int")), F.when(F.col(n) % F.col(size) > 0, F.array(F.col(n) % F.col(size))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn(part, F.explode(lengths))
    text = F.when(F.col(part) == F.col(size), F.col("text")).otherwise(F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col(part).cast("int")), " "))
    d = d.withColumn("text", text)
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)
