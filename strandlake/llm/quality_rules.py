"""Operator 4: quality rules with risk-controlled thresholds (native).

Documents that fail the base rules are rejected outright. For the rest, every rule is a number that is high for junk;
its cutoff is chosen per stratum from labelled holdout documents: a cutoff is *certified* if the exact binomial test
rejects "more than ``risk`` of this stratum's good documents are at or above it", at a level that Holm's step-down
correction shares among all (stratum, rule, cutoff) hypotheses. The certified cutoff with the best gain is used; a
stratum without one rejects nothing more. The cutoff grid is fixed beforehand, so the holdout is used once.

Nulls: a null text is empty (no words, base_failed). A null stratum is a stratum of its own. Labels with null doc_id or
quality are ignored; a document labelled twice counts as good only if all its labels are. Repeated rows give repeated
rows; ties at the cutoff are rejected (``>=``). Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, documents, fresh, labels, shl, words

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    """risk: share of a stratum's good documents that may be rejected in all, shared evenly by the rules; delta: the
    chance that any guarantee fails; cost: how many kept junk documents one rejected good document weighs."""

    risk: float = 0.05
    delta: float = 0.05
    cost: float = 10.0
    grid: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {
            "symbol_share": (0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3),
            "dup_line_share": (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
            "repeat_share": (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4),
            "word_length": (6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0),
        }
    )


def with_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the base counts of each document's whole text, in one pass without a shuffle.

    Repeats: the 3-word windows become sorted longs (hash above, window number below, in as many bits as the document
    needs); equal neighbours, confirmed word by word, are windows that occur again.
    """
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    d = d.withColumn("_w", words(F.col("_text"))).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.ltrim(x, F.lit(SPACE)) != ""))
    d = d.select(
        *keep,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.bin(F.size("_w").cast("long"))).alias("_bits"),
    )

    bits = F.col("_bits")

    def window(i: Column) -> Column:
        h = F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
        return shl(F.call_function("shiftrightunsigned", h, bits + 1), bits).bitwiseOR(i.cast("long"))

    d = d.withColumn("_s", F.when(F.col("n_words") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_w") - 3), window))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_over", shl(F.lit(1).cast("long"), bits))
    near = lambda x, j: x.bitwiseXOR(F.get("_s", j)) < F.col("_over")  # noqa: E731  the values are positive
    d = d.withColumn("_c", F.filter("_s", lambda x, j: near(x, j - 1) | near(x, j + 1)))
    at = lambda x: x.bitwiseAND(F.col("_over") - 1).cast("int")

    def same(x: Column, y: Column) -> Column:
        equal = x.bitwiseXOR(y) < F.col("_over")
        for k in range(3):
            equal = equal & (F.get("_w", at(x) + k) == F.get("_w", at(y) + k))
        return F.coalesce(equal, F.lit(False))

    # two references to each array keep the optimizer from evaluating it again inside the lambdas
    d = d.withColumn("_p", F.sort_array(F.transform(F.filter("_c", lambda x, j: same(x, F.get("_c", j - 1)) | same(x, F.get("_c", j + 1))), at)))
    covered = F.aggregate(
        F.transform("_p", lambda p, j: F.when(j == 0, F.lit(3).cast("long")).otherwise(F.least(F.lit(3).cast("long"), (p - F.get("_p", j - 1)).cast("long")))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return d.select(*keep, *STATS[:4], "n_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def scores() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in logarithms so that no term underflows."""
    odds = p / (1 - p)
    first = n * F.log1p(F.lit(-p))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i.cast("double") * F.lit(odds))
        high, low = F.greatest(s["sum"], term), F.least(s["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    ks = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    out = F.aggregate(ks, F.struct(first.alias("term"), first.alias("sum")), step, lambda s: F.exp(s["sum"]))
    return F.when(k >= n, F.lit(1.0)).otherwise(out)


def tested(scored: DataFrame, stratum: str, rules: Rules) -> DataFrame:
    """Every (stratum, rule, cutoff): what it rejects of the good and bad, its p-value, whether it is certified.

    ``scored``: the holdout with the stratum, ``good`` and a column for each rule. Rows counted: grid size x strata.
    """
    grid = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), (F.col(r) >= F.lit(c)).alias("hit")) for r, cs in rules.grid.items() for c in cs))
    t = (
        scored.select(F.col(stratum).alias("stratum"), "good", F.explode(grid).alias("g"))
        .groupBy("stratum", "g.rule", "g.cutoff")
        .agg(
            F.count_if("good").alias("n_good"),
            F.count_if(~F.col("good")).alias("n_bad"),
            F.count_if(F.col("good") & F.col("g.hit")).alias("k_good"),
            F.count_if(~F.col("good") & F.col("g.hit")).alias("k_bad"),
        )
    )
    t = t.withColumn("p_value", binomial_tail(F.col("k_good"), F.col("n_good"), rules.risk / len(rules.grid)))
    # Holm: the i-th smallest of m p-values is held against delta / (m - i + 1); the first failure ends it
    order = Window.orderBy("p_value", F.col("stratum").asc_nulls_first(), "rule", F.col("cutoff").desc())
    t = t.withColumn("_i", F.row_number().over(order)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy()))
    return t.withColumn("certified", F.max((F.col("p_value") > rules.delta / (F.col("_m") - F.col("_i") + 1)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 0).drop("_i", "_m")


def cutoffs(t: DataFrame, rules: Rules) -> DataFrame:
    """For each stratum a map from rule to the certified cutoff of largest gain (ties: the highest cutoff)."""
    rate = lambda k, n: F.coalesce(F.try_divide(F.col(k).cast("double"), F.col(n).cast("double")), F.lit(0.0))
    gain = F.round(rate("k_bad", "n_bad") - rules.cost * rate("k_good", "n_good"), 9)
    best = t.where("certified").withColumn("gain", gain).where("gain > 0").groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))


def judge(docs: DataFrame, labelled: DataFrame, stratum: str = "lang", rules: Rules | None = None) -> DataFrame:
    """doc_id, the stratum, the base counts, base_failed, kept and the cutoffs used, one row for each row of ``docs``.

    ``labelled``: doc_id, quality (1 good, 0 bad): the holdout. The counts are checkpointed, so texts are read once.
    """
    rules = rules or Rules()
    stats = cut(with_stats(docs.select("doc_id", F.col(stratum).alias("stratum"), "text"), ["doc_id", "stratum"])).withColumn("base_failed", base_failed())
    marks = labelled.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") >= 1).alias("good"))
    holdout = stats.where(~F.col("base_failed")).join(marks, "doc_id").select("stratum", "good", *(c.alias(r) for r, c in scores().items()))
    cuts = cutoffs(tested(holdout, "stratum", rules), rules)
    out = stats.join(cuts.select(F.col("stratum").alias("_stratum"), "cuts"), F.col("stratum").eqNullSafe(F.col("_stratum")), "left").drop("_stratum")
    hit = F.lit(False)
    for r, c in scores().items():
        hit = hit | F.coalesce(c >= F.col("cuts")[r], F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~hit)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), labels(spark, sf_dir)).select("doc_id", *STATS, "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the documents that pass; of texts that share a doc_id, one that passes keeps them all."""
    (key,) = fresh(docs, "_key")
    kept = judge(docs, labels(spark, sf_dir)).where("kept").select(F.col("doc_id").alias(key))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


ORACLE = r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
s AS (SELECT w.doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
        CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share,
        CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length FROM s),
grid AS (
  SELECT 'symbol_share' AS rule, unnest([0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3]::DOUBLE[]) AS cutoff
  UNION ALL SELECT 'dup_line_share', unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[])
  UNION ALL SELECT 'repeat_share', unnest([0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4]::DOUBLE[])
  UNION ALL SELECT 'word_length', unnest([6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0]::DOUBLE[])),
long AS (SELECT doc_id, lang, base_failed, rule, CASE rule WHEN 'symbol_share' THEN symbol_share WHEN 'dup_line_share' THEN dup_line_share
           WHEN 'repeat_share' THEN repeat_share ELSE word_length END AS v FROM b, (SELECT DISTINCT rule FROM grid)),
marks AS (SELECT doc_id, min(quality) >= 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
counts AS (SELECT lang, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS nb, count(*) FILTER (good AND v >= cutoff) AS k,
             count(*) FILTER (NOT good AND v >= cutoff) AS kb
           FROM long JOIN marks USING (doc_id) JOIN grid USING (rule) WHERE NOT base_failed GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
        lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.0125) + (n - i) * ln(0.9875)))) END AS p FROM counts),
h AS (SELECT *, row_number() OVER (ORDER BY p, lang NULLS FIRST, rule, cutoff DESC) AS i, count(*) OVER () AS m FROM p),
c AS (SELECT *, max(CASE WHEN p > 0.05 / (m - i + 1) THEN 1 ELSE 0 END) OVER (ORDER BY i) = 0 AS certified FROM h),
g AS (SELECT *, round(coalesce(kb / nullif(nb, 0), 0) - 10 * coalesce(k / nullif(n, 0), 0), 9) AS gain FROM c WHERE certified),
best AS (SELECT lang, rule, arg_max(cutoff, (gain, cutoff)) AS cutoff FROM g WHERE gain > 0 GROUP BY lang, rule),
hit AS (SELECT DISTINCT doc_id FROM long JOIN best ON long.rule = best.rule AND long.lang IS NOT DISTINCT FROM best.lang WHERE v >= cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hit) AS kept FROM b
"""
