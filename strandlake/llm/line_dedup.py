"""Operator 8: line dedup by a segment-partition edit join.

Lines within ``threshold`` edits (of code points) are linked, and at most one edit for every ``per_edit`` code points of the
shorter line: of two words one is not the other with most of its letters changed. Two lines within t edits share one of the
t + 1 even segments of the shorter one, unchanged and hardly moved:

1. every distinct line of a task gives the t + 1 segment keys (length, segment number, hash) of its own length, and for each
   length from its own down to t less the keys of the substrings that can match a segment (multi-match-aware selection);
2. lines that share a key are candidates; of each line a 512-bit map of the parities of its hashed letter pairs goes along,
   and lines whose maps differ in more than 4 bits an edit are turned down without their texts. A hot key is split into cells
   of bounded size; a cell returns only pairs that pass;
3. the texts of the remaining lines are fetched through a Bloom filter of bounded size and an exact join, and each pair is
   verified by a banded bit-parallel edit distance.

Classes are connected components of links. Of a class, a document keeps its first line. A class that has a line of
``long_chars`` code points or more stays only in the first of its documents (by doc_id); one of shorter lines is boilerplate,
and does so too, if found in ``min_docs`` documents or more. Blank lines are never dropped.

Nulls: a null text has no lines and stays null; null doc_ids come first in the order. Lines are identified by a 64-bit
hash. Equal rows have equal results; rows that share a doc_id are documents of their own, ordered by their texts' hash.
An empty table gives an empty result. Extra columns are kept by :func:`stage` and ignored otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bloom import bloom
from .common import cut, documents, fresh, stash
from .components import components
from .textops import _BYTE, _SPACE, U64, _power, blocks, mix, release, span_hashes, tidy


@dataclass(frozen=True)
class LineDedup:
    threshold: int = 2
    per_edit: int = 12
    min_docs: int = 8
    #: Lines of over 50 words have 101 code points at least, wrapped lines of 70 to 80 columns mostly 64 or more.
    long_chars: int = 64
    cell: int = 512

    def allowed(self, length):
        """Edits that a line of so many code points may have."""
        return np.minimum(self.threshold, length // self.per_edit)


MAP_BITS = 512
#: Bytes of text worked on at once: a byte takes some twenty words of scratch where keys or maps are made, which should stay in
#: a core's cache.
BLOCK = 1 << 18
#: Places where a task remembers hashes of lines that it sent keys for; one that finds another hash in its place takes it.
SEEN = 1 << 20


def line_blocks(column: pa.Array):
    """(index of the first text, number of its first line here, bytes, offsets) for about BLOCK bytes; a longer text comes in
    parts cut at line feeds."""
    for i, data, offsets in blocks(column, BLOCK):
        if len(offsets) > 2 or len(data) <= BLOCK:
            yield i, 0, data, offsets
            continue
        at, number = 0, 0
        while at < len(data):
            feeds = np.flatnonzero(data[at : at + BLOCK] == 10)
            if at + BLOCK < len(data) and not len(feeds):  # within a line longer than a block
                step = 8 * BLOCK
                end = next((j + int(f[0]) for j in range(at + BLOCK, len(data), step) if len(f := np.flatnonzero(data[j : j + step] == 10))), len(data))
            else:
                end = at + int(feeds[-1]) if at + BLOCK < len(data) else len(data)
            part = data[at:end]
            yield i, number, part, np.array([0, len(part)])
            number += int(np.count_nonzero(part == 10)) + 1
            at = end + 1


class Lines:
    """The non-blank lines of a block of texts: byte ranges, numbers within their text, lengths in code points, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.data = data
        feed = np.flatnonzero(data == 10)
        # a line starts at each text and after each line feed; it ends before the next feed or text
        starts = np.concatenate((offsets[:-1], feed + 1))
        owner = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, feed, "right") - 1))
        order = np.lexsort((starts, owner))
        starts, owner = starts[order], owner[order]
        first = np.searchsorted(owner, np.arange(len(offsets) - 1))
        number = np.arange(len(starts)) - first[owner]
        own_end = offsets[owner + 1]
        nxt = np.append(feed, n)[np.searchsorted(feed, starts)]
        ends = np.minimum(nxt, own_end)
        keep = ends > starts
        # most lines start with a character that is no white space; the others are looked at as a whole
        doubt = np.flatnonzero(keep)
        doubt = doubt[_SPACE[data[starts[doubt]]]]
        if len(doubt):
            size = ends[doubt] - starts[doubt]
            before = np.cumsum(size) - size
            at = np.repeat(starts[doubt] - before, size) + np.arange(size.sum())
            keep[doubt] = np.add.reduceat(~_SPACE[data[at]], before, dtype=np.int64) > 0
        self.starts, self.ends, self.owner, self.number = starts[keep], ends[keep], owner[keep], number[keep]
        further = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that start no code point
        self.length = self.ends - self.starts - (np.searchsorted(further, self.ends) - np.searchsorted(further, self.starts))

    @cached_property
    def hash(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def maps(self, rows: np.ndarray) -> np.ndarray:
        """512-bit maps, packed, of the lines ``rows``: of each hashed pair of code points, whether it occurs an odd number of
        times. An edit takes away two pairs at most and adds two, so it flips four bits at most."""
        letters = Letters(self, rows)
        if len(letters.cp) < 3:
            return np.zeros((len(rows), MAP_BITS // 8), np.uint8)
        i = np.arange(len(letters.cp) - 1)
        point = letters.part(i, i + 1)
        pair = ((point[:-1] * U64(3) + (point[1:] << U64(1))) * U64(0x9E3779B97F4A7C15) >> U64(55)).astype(np.int64)
        n = np.maximum(self.length[rows] - 1, 0)
        before = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(letters.a - before[:-1], n) + np.arange(before[-1])
        counts = np.bincount(np.repeat(np.arange(len(rows)) * MAP_BITS, n) + pair[at], minlength=len(rows) * MAP_BITS)
        return np.packbits((counts & 1).astype(bool).reshape(len(rows), MAP_BITS), axis=1)


class Letters:
    """The code points of some lines, one line after another, with hashes of their runs; line i has those from ``a[i]`` on."""

    def __init__(self, lines: Lines, rows: np.ndarray):
        size = lines.ends[rows] - lines.starts[rows]
        before = np.cumsum(size) - size
        data = lines.data[np.repeat(lines.starts[rows] - before, size) + np.arange(size.sum())] if len(rows) else lines.data[:0]
        n = len(data)
        self.cp = np.append(np.flatnonzero((data & 0xC0) != 0x80), n)  # byte offsets of code points
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[data] * _power("up", n), out=self.sums[1:]) if n else None
        self.down = _power("down", n + 1)
        self.a = np.cumsum(lines.length[rows]) - lines.length[rows]

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of code points a..b."""
        x, y = self.cp[a], self.cp[b]
        return mix((self.sums[y] - self.sums[x]) * self.down[x])


def segments(length: np.ndarray, i: int, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the i-th (from 0) of t + 1 even segments; the longer ones come last."""
    base, extra = length // (t + 1), length % (t + 1)
    short = t + 1 - extra
    return base * i + np.maximum(0, i - short), base + (i >= short)


def keys_of(lines: Lines, rows: np.ndarray, p: LineDedup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, whether an index key) of the lines ``rows``: their own segments, and the substrings to probe with."""
    keys, where, own = [np.zeros(0, U64)], [np.zeros(0, int)], [np.zeros(0, bool)]
    size, letters = lines.length[rows], Letters(lines, rows)

    def add(l_: np.ndarray, i: int, a: np.ndarray, n: np.ndarray, ok: np.ndarray, index: bool) -> None:
        at, n = letters.a[ok] + a[ok], n[ok]
        keys.append(mix(letters.part(at, at + n) + l_[ok].astype(U64) * U64(0xD1B54A32D192ED03) + U64(i)))
        where.append(rows[ok])
        own.append(np.full(len(n), index))

    for d in range(p.threshold + 1):
        l_ = size - d
        t = p.allowed(np.maximum(l_, 0))  # of a pair whose shorter line has this length
        for i in range(p.threshold + 1):
            at, n = segments(np.maximum(l_, 0), i, t)
            for o in range(-p.threshold, p.threshold + d + 1):
                # the segment moved by o: by at most i edits before it, and at most t - i after it
                ok = (t >= max(1, i, d)) & (abs(o) <= i) & (abs(o - d) <= t - i) & (at + o >= 0) & (at + o + n <= size)
                if ok.any():
                    add(l_, i, at + o, n, ok, d == 0 and o == 0)
    return np.concatenate(keys), np.concatenate(where), np.concatenate(own)


def within_edits(a: str, b: str, t: int) -> bool:
    """Whether the edit distance is at most t: common ends are cut off, then a band of 2t + 1 diagonals is kept in the
    bits of two words (vertical steps up and down), moved down by one row for each letter of ``b``."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > t:
        return False
    low, high = 0, 0
    while low < len(b) and a[low] == b[low]:
        low += 1
    while high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not b:
        return len(a) <= t
    width = 2 * t + 1
    full, bottom = (1 << width) - 1, 1 << (width - 1)
    match: dict[str, int] = {}
    for k, c in enumerate(a):
        match[c] = match.get(c, 0) | 1 << (k + t)  # a letter's row k is bit k + t - j in column j
    plus, minus = full ^ ((1 << t) - 1), 0  # column 0 holds 0, 1, 2, ...
    distance = t  # of the band's bottom cell; rows beyond ``a`` never match
    for j, c in enumerate(b):
        eq = (match.get(c, 0) >> j) & full
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & full  # cells equal to their upper left neighbour
        right_plus = (minus | ~(diagonal | plus)) & full
        right_minus = diagonal & plus
        distance += not diagonal & bottom
        shifted = diagonal >> 1
        plus = (right_minus | ~(shifted | right_plus)) & full
        minus = shifted & right_plus
    # the steps are those of the last column, a row further down; climb from row len(b) + t to row len(a)
    for row in range(len(b) + t, len(a), -1):
        bit = row - len(b) - 1 + t
        distance -= (plus >> bit & 1) - (minus >> bit & 1)
    return distance <= t


def _key_rows(docs: DataFrame, p: LineDedup) -> DataFrame:
    @tidy
    def run(batches):
        seen = np.arange(1, SEEN + 1, dtype=U64)  # no hash that belongs in its place
        for batch in batches:
            for _, _, data, offsets in line_blocks(batch.column(0)):
                lines = Lines(data, offsets)
                rows = np.flatnonzero(p.allowed(lines.length) > 0)
                rows = rows[np.unique(lines.hash[rows], return_index=True)[1]]
                at = lines.hash[rows] & U64(SEEN - 1)
                new = seen[at] != lines.hash[rows]
                rows, at = rows[new], at[new]
                if not len(rows):
                    continue
                seen[at] = lines.hash[rows]
                key, row, own = keys_of(lines, rows, p)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(lines.hash[row].view(np.int64)), pa.array(own)], ["key", "h", "own"])

    return docs.select("text").mapInArrow(run, "key long, h long, own boolean")


def _line_rows(docs: DataFrame, wanted, what: str) -> DataFrame:
    """(h, value) of the lines that a Bloom filter lets through: their letter maps or their texts; repeats remain."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    @tidy
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in line_blocks(batch.column(0)):
                lines = Lines(data, offsets)
                rows = np.flatnonzero(shared.value.may_have(lines.hash)) if len(lines.hash) else np.zeros(0, int)
                if not len(rows):
                    continue
                rows = rows[np.unique(lines.hash[rows], return_index=True)[1]]
                if what == "map":
                    values = [m.tobytes() for m in lines.maps(rows)]
                else:
                    values = [data[a:b].tobytes() for a, b in zip(lines.starts[rows], lines.ends[rows], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(lines.hash[rows].view(np.int64)), pa.array(values, pa.binary())], ["h", "value"])

    return docs.select("text").mapInArrow(run, "h long, value binary").groupBy("h").agg(F.first("value").alias("value"))


def _cells(rows: DataFrame, p: LineDedup) -> DataFrame:
    """Deals the rows of a key with more than ``cell`` lines to cells (key, x, y) that meet every pair once."""
    rows = rows.withColumn("parts", F.ceil(F.col("members") / F.lit(p.cell)).cast("int")).withColumn("i", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1).cast("int")
    return rows.select("key", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "h", "own", side.alias("side"), "value")


def _similar(batches, most: int):
    """Pairs (u < v) of each cell whose maps differ in at most ``most`` bits; cells arrive whole and in order."""
    rest = None

    def pairs(t: pa.Table) -> pa.RecordBatch:
        k = np.stack([t.column(c).to_numpy() for c in ("key", "x", "y")])
        h, own, side = t.column("h").to_numpy(), t.column("own").to_numpy(), t.column("side").to_numpy()
        maps = np.frombuffer(b"".join(t.column("value").to_pylist()), np.uint64).reshape(len(h), -1)
        group = np.concatenate(([0], np.cumsum((k[:, 1:] != k[:, :-1]).any(axis=0))))
        last = np.searchsorted(group, group, "right")
        out, at, d = [], np.arange(len(h)), 1
        at = at[at + d < last[at]]
        while len(at):
            j = at + d
            ok = (own[at] | own[j]) & ((side[at] != side[j]) | (side[at] == 2)) & (h[at] != h[j])
            i, j = at[ok], j[ok]
            near = np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1) <= most
            out.append(np.stack((np.minimum(h[i], h[j])[near], np.maximum(h[i], h[j])[near])))
            d += 1
            at = at[at + d < last[at]]
        u, v = np.unique(np.concatenate(out, axis=1), axis=1) if out and sum(o.shape[1] for o in out) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not len(t):
            continue
        k = np.stack([t.column(c).to_numpy() for c in ("key", "x", "y")])
        whole = int(np.flatnonzero((k != k[:, -1:]).any(axis=0))[-1]) + 1 if (k != k[:, -1:]).any() else 0
        if whole:
            yield pairs(t.slice(0, whole))
        rest = t.slice(whole)
    if rest is not None and len(rest):
        yield pairs(rest)


def edit_links(docs: DataFrame, params: LineDedup | None = None) -> DataFrame:
    """(u, v), u < v: hashes of all pairs of different lines within the threshold."""
    p = params or LineDedup()
    key = Window.partitionBy("key")
    # one shuffle, by key: most keys have one line and end here; only what is left is freed of repeats and counted
    rows = _key_rows(docs, p).withColumns({"_low": F.min("h").over(key), "_high": F.max("h").over(key), "_any": F.max("own").over(key)})
    rows = rows.where("_low <> _high and _any").groupBy("key", "h").agg(F.max("own").alias("own"))
    rows = cut(rows.withColumn("members", F.count(F.lit(1)).over(key)))
    maps = _line_rows(docs, bloom(rows.select("h").distinct()), "map")
    met = _cells(rows.join(maps, "h"), p)
    most = 4 * p.threshold
    near = met.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(tidy(lambda b: _similar(b, most)), "u long, v long")
    near = cut(near.distinct())
    texts = stash(_line_rows(docs, bloom(near.select("u").union(near.select("v")).distinct()), "text"))

    def close(a: str, b: str) -> bool:
        return within_edits(a, b, int(p.allowed(min(len(a), len(b)))))

    @tidy
    def verify(batches):
        for pdf in batches:
            ok = [close(bytes(a).decode(), bytes(b).decode()) for a, b in zip(pdf.a, pdf.b, strict=True)]
            yield pdf.loc[np.array(ok, bool), ["u", "v"]] if len(pdf) else pdf[["u", "v"]]

    both = near.join(texts.select(F.col("h").alias("u"), F.col("value").alias("a")), "u").join(texts.select(F.col("h").alias("v"), F.col("value").alias("b")), "v")
    return cut(both.select("u", "v", "a", "b").mapInPandas(verify, "u long, v long"))


def occurrences(docs: DataFrame, mark: str) -> DataFrame:
    """doc_id, dk, line, h, size (code points): every non-blank line; the column ``mark`` (a hash of the text) becomes ``dk``.
    Equal rows give equal lines."""

    @tidy
    def run(batches):
        for batch in batches:
            for i, number, data, offsets in line_blocks(batch.column(2)):
                lines = Lines(data, offsets)
                at = pa.array(lines.owner + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array((lines.number + number).astype(np.int32)), pa.array(lines.hash.view(np.int64)), pa.array(lines.length.astype(np.int32))], ["doc_id", "dk", "line", "h", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(mark).alias("dk"), "text").mapInArrow(run, "doc_id long, dk long, line int, h long, size int")


COUNTS = ["n_lines", "n_dropped", "n_linked", "n_links", "n_shared"]


def dedup(docs: DataFrame, params: LineDedup | None = None, names: list[str] | None = None) -> DataFrame:
    """All columns of ``docs`` with the text deduplicated, and n_lines, n_dropped, n_linked, n_links, n_shared of each row.

    n_linked: its lines that are linked with a different line of the corpus; n_links: the links of these lines;
    n_shared: its lines whose class is found in other documents too. A column of ``docs`` that has one of these names
    stays, and the count's name gets underscores before it (see :func:`fresh`); ``names`` gives others.
    """
    p = params or LineDedup()
    names = names or fresh(docs, *COUNTS)
    mark, id_, dk, gone, cls_ = fresh(docs, "_mark", "_id", "_dk", "_drop", "_cls")
    d = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    links = edit_links(d, p)
    comp = components(links)
    degree = links.select(F.col("u").alias("h")).union(links.select(F.col("v").alias("h"))).groupBy("h").agg(F.count(F.lit(1)).alias("links"))
    of_line = cut(comp.join(degree, comp["id"] == degree["h"]).select("id", "component", "links"))
    rows = occurrences(d, mark)
    rows = rows.join(of_line, rows["h"] == of_line["id"], "left").select("doc_id", "dk", "line", "size", F.coalesce("component", "h").alias("cls"), F.coalesce("links", F.lit(0)).alias("links"))
    # one row for each class of a document, then for each class: how many documents, and the first
    per_doc = rows.groupBy("cls", "doc_id", "dk").agg(F.min("line").alias("keep"), F.collect_set("line").alias("lines"), F.count(F.lit(1)).alias("met"), F.count_if(F.col("links") > 0).alias("linked"), F.sum("links").alias("links"), F.max("size").alias("size"))
    times = F.col("met") / F.size("lines")  # how many equal rows there are
    per_doc = stash(per_doc.withColumns({c: (F.col(c) / times).cast("long") for c in ("linked", "links")}).drop("met"))
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "dk")
    common = per_doc.groupBy("cls").agg(F.count(F.lit(1)).alias("docs"), F.min(order).alias("first"), F.max("size").alias("size")).where("docs > 1")
    once = (F.col("docs") >= p.min_docs) | (F.col("size") >= p.long_chars)
    common = cut(common.select(F.col("cls").alias("_cls"), F.when(once, F.col("first")).alias("first")))
    met = per_doc.join(common, F.col("cls") == F.col("_cls"), "left")
    stays = F.col("first").isNull() | (F.col("first") == order)
    met = met.withColumn("drop", F.filter("lines", lambda x: ~stays | (x != F.col("keep"))))
    per = met.groupBy(F.col("doc_id").alias(id_), F.col("dk").alias(dk)).agg(
        F.sum(F.size("lines")).alias("l"), F.sum("linked").alias("k"), F.sum("links").alias("i"), F.sum(F.when(F.col("_cls").isNotNull(), F.size("lines"))).alias("s"), F.flatten(F.collect_list(F.when(F.size("drop") > 0, F.col("drop")))).alias("drop")
    )
    per = per.select(id_, dk, F.struct("l", "k", "i", "s", "drop").alias(gone))
    out = d.join(per, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(mark) == F.col(dk)), "left")

    @F.pandas_udf("string")
    def without(text: pd.Series, drop: pd.Series) -> pd.Series:
        def one(t, gone):
            if t is None or gone is None or not len(gone):
                return t
            gone = set(gone)
            return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)

        out = pd.Series([one(t, g) for t, g in zip(text, drop, strict=True)], dtype=object)
        release()
        return out

    of = F.col(gone)
    dropped = F.coalesce(F.greatest(F.size(of["drop"]), F.lit(0)), F.lit(0))
    # Python is given every row, whatever stands around the call: texts that stay as they are do not go there
    text = F.when(dropped > 0, without(F.when(dropped > 0, F.col("text")), F.when(dropped > 0, of["drop"]))).otherwise(F.col("text")).alias("text")
    counts = [of["l"], dropped, of["k"], of["i"], of["s"]]
    return out.select(*(text if c == "text" else F.col(c) for c in docs.columns), *(F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in zip(counts, names, strict=True)))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir).select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines that the dedup drops; n_chars follows the text. Extra columns stay as they are,
    whatever their names."""
    out = dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
