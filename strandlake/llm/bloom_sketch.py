"""Operator 2: document fingerprints as invertible Bloom lookup sketches over paragraph digests (native).

A text is cut into paragraphs (at line feeds, and within a line at sentence ends, so that a text of one line has parts
too). Each distinct paragraph has a 64-bit digest: 47 bits of hash, 16 bits that check them, and a last bit that is always
set. A sketch has three rows of cells; a digest is added, by exclusive or, to the cell of each row that its bits name. So
a cell holds the sum of its digests' hashes, of their checks, and the parity of their number.

Subtracting two sketches is again exclusive or: equal paragraphs cancel and what is left is the sketch of the difference.
A cell of odd parity whose check fits its hash holds one digest; peeling takes it out of its three cells, which may bare
others. It succeeded when every cell is zero. The fingerprint is the smallest sketch (24 cells); if its difference can't be
peeled, both texts' digests are dealt to shards of about ten, each with its own sketch, and a shard that fails is
tried with cells twice and four times as many and placed by other bits, at last by comparing its digests themselves.

Likeness is 1 - differing / (paragraphs of both): 1 for equal sets, 0 for disjoint ones; two texts without paragraphs are
alike, one without and one with are not.

Nulls: a null text is empty. The next document is the next distinct (doc_id, text) in descending doc_id, equal doc_ids in
the order of their texts' hash, null doc_ids last; a repeated row has the same next as its twin. One document is its own
next. The smallest 64-bit number is no doc_id: it stands for null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, documents, let, shl, within

PARAGRAPH = r"\n|(?<=[.!?])[\x20\x09-\x0D]+"
#: Cells in a row of the sketch at each attempt, and the first of the digest's bits that place it.
SIZES = [(8, 17), (8, 17), (16, 26), (32, 38)]
PER_SHARD = 10
ROUNDS = 12


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _shr(x: Column, n: int | Column) -> Column:
    return F.call_function("shiftrightunsigned", x, F.lit(n) if isinstance(n, int) else n)


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""

    def digest(p: Column) -> Column:
        return let(_shr(F.xxhash64(p), 17), lambda k: shl(k, F.lit(17)).bitwiseOR(shl(_shr(F.xxhash64(k), 48), F.lit(1))).bitwiseOR(_long(1)))

    parts = F.filter(F.split(text, PARAGRAPH), lambda p: F.ltrim(p, F.lit(SPACE)) != "")
    return F.array_distinct(F.transform(parts, digest))


def _in_cell(d: Column, i: Column, size: int, bit: int) -> Column:
    """Whether digest ``d`` is added to cell ``i`` (rows of ``size`` cells, one after another)."""
    log = size.bit_length() - 1
    row = F.call_function("shiftright", i, F.lit(log))
    return _shr(d, bit + log * row).bitwiseAND(_long(size - 1)) == i.bitwiseAND(F.lit(size - 1)).cast("long")


def sketch(ds: Column, size: int = 8, bit: int = 17) -> Column:
    def cell(i: Column) -> Column:
        return F.aggregate(ds, _long(0), lambda x, d: F.when(_in_cell(d, i, size, bit), x.bitwiseXOR(d)).otherwise(x))

    return F.transform(F.sequence(F.lit(0), F.lit(3 * size - 1)), cell)


def peel(cells: Column, size: int = 8, bit: int = 17) -> Column:
    """The digests in a sketch, null if it can't be peeled."""
    pure = lambda x: (x.bitwiseAND(_long(1)) == 1) & (_shr(x, 1).bitwiseAND(_long(0xFFFF)) == _shr(F.xxhash64(_shr(x, 17)), 48))
    empty = lambda c: (F.array_max(c) == 0) & (F.array_min(c) == 0)

    def round_(state: Column, _: Column) -> Column:
        def take(ps: Column) -> Column:
            rest = F.transform(state["cells"], lambda x, i: F.aggregate(ps, x, lambda y, p: F.when(_in_cell(p, i, size, bit), y.bitwiseXOR(p)).otherwise(y)))
            # a digest that comes up again (its cell's check fitted by chance before) cancels itself here as in the cells
            keys = F.concat(F.array_except(state["keys"], ps), F.array_except(ps, state["keys"]))
            return F.struct(rest.alias("cells"), keys.alias("keys"), (F.size(ps) == 0).alias("stuck"))

        return F.when(state["stuck"] | empty(state["cells"]), state).otherwise(let(F.array_distinct(F.filter(state["cells"], pure)), take))

    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("keys"), F.lit(False).alias("stuck"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda s: F.when(empty(s["cells"]), s["keys"]))


def difference(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    """The digests that one of two texts has and the other lacks; ``fa``, ``fb`` are their smallest sketches.

    Shards are dealt out in two steps of about the square root of their number, so a text of n paragraphs takes n^1.5 steps.
    """
    minus = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    odd = lambda x: F.ceil(x).cast("long").bitwiseOR(_long(1))
    shards = F.ceil((F.size(a) + F.size(b)) / F.lit(PER_SHARD))

    def dealt(x: Column, y: Column, bit: int, n: Column, then) -> Column:
        def part(k: Column) -> Column:
            mine = lambda ds: F.filter(ds, lambda d: F.pmod(_shr(d, bit), n) == k)
            return let(F.struct(mine(x).alias("a"), mine(y).alias("b")), lambda ab: then(ab["a"], ab["b"]))

        return F.flatten(F.transform(F.sequence(_long(0), n - 1), part))

    def solve(x: Column, y: Column) -> Column:
        tries = [peel(minus(sketch(x, s, bit), sketch(y, s, bit)), s, bit) for s, bit in SIZES[1:]]
        return F.coalesce(*tries, F.concat(F.array_except(x, y), F.array_except(y, x)))

    def larger(n: Column) -> Column:
        return dealt(a, b, 17, n["groups"], lambda x, y: dealt(x, y, 33, n["each"], solve))

    groups = odd(F.sqrt(shards))
    return F.coalesce(peel(minus(fa, fb)), let(F.struct(groups.alias("groups"), odd(shards / groups).alias("each")), larger))


def likeness(a: Column, b: Column, different: Column) -> Column:
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(1.0 - F.size(different).cast("double") / n)


def as_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), _long(-(1 << 63))).alias("k"), F.xxhash64(text).alias("th"))


def predecessors(keyed: DataFrame, parts: int) -> DataFrame:
    """k, th -> pk, pth, pn: the document before each in descending doc_id (the last one before the first), and its length.

    Range partitions of the keys alone are sorted each by itself; their ends meet in a table of a row for each partition.
    """
    order = [F.col("k").desc(), F.col("th").asc()]
    ids = keyed.select("k", "th", F.length("text").cast("long").alias("n")).distinct()
    ids = cut(ids.repartitionByRange(parts, *order).select("k", "th", "n", F.spark_partition_id().alias("part")))
    own = Window.partitionBy("part").orderBy(*order)
    rows = ids.withColumn("p", F.lag(F.struct("k", "th", "n")).over(own))
    ends = ids.groupBy("part").agg(F.max_by(F.struct("k", "th", "n"), F.struct(F.bitwise_not("k"), "th")).alias("end"))  # the complement turns the order round
    line = Window.orderBy("part")
    ends = ends.withColumn("before", F.coalesce(F.lag("end").over(line), F.last("end").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    rows = rows.join(within(ends.select(F.col("part").alias("_part"), "before"), 1_000_000), F.col("part") == F.col("_part"))
    p = F.coalesce("p", "before")
    return rows.select("k", "th", p["k"].alias("pk"), p["th"].alias("pth"), p["n"].alias("pn"))


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs, n_changed.

    Texts are shuffled once, by document (both uses read the same columns, so Spark reuses the exchange); then each document sends what its predecessor needs of it: the code points that
    go into the edited text, and its digests.
    """
    keyed = _keyed(docs)
    before = cut(predecessors(keyed, parts or docs.rdd.getNumPartitions()))
    own = keyed.join(before, ["k", "th"])
    sent = own.select(F.col("pk").alias("k"), F.col("pth").alias("th"), F.substring("text", F.lit(1), F.floor(F.col("pn") / 3).cast("int")).alias("begin"), digests(F.col("text")).alias("next_d"))
    sent = sent.groupBy("k", "th").agg(F.first("begin").alias("begin"), F.first("next_d").alias("next_d"))
    d = keyed.join(sent, ["k", "th"]).withColumn("n_chars", F.length("text").cast("long"))
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")), F.col("begin")))
    d = d.select(F.nullif("k", _long(-(1 << 63))).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("d"), digests(F.col("edited")).alias("e"), "next_d")
    d = d.withColumns({"fd": sketch(F.col("d")), "fe": sketch(F.col("e")), "fn": sketch(F.col("next_d"))})
    d = d.withColumns({"de": difference(F.col("d"), F.col("e"), F.col("fd"), F.col("fe")), "dn": difference(F.col("d"), F.col("next_d"), F.col("fd"), F.col("fn"))})
    return d.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fd")).alias("fingerprint"),
        as_text(F.col("fe")).alias("edited_fingerprint"),
        likeness(F.col("d"), F.col("e"), F.col("de")).alias("near_edited"),
        likeness(F.col("d"), F.col("next_d"), F.col("dn")).alias("near_next"),
        F.size("d").cast("long").alias("n_paragraphs"),
        F.size("de").cast("long").alias("n_changed"),
    )


def op2_bloom_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
