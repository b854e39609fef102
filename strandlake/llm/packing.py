"""Operator 10: packing by lexical retrieval.

1. One pass encodes the texts; their ids are written down, with the document frequency of every token id.
2. Documents are dealt to shards of about ``shard_tokens`` by content: token ids are ranked by an exponential draw over their
   idf, over all documents; a document's key is the least rank among its ids (so two documents agree with the weighted
   Jaccard similarity of their id sets as probability, and rare ids count most), by a second ranking where a key holds more
   than a shard, and by the row's number where both do. So like documents share a shard and none overflows.
3. A shard builds an inverted index with BM25 weights (document frequencies, number and mean length of all documents) and fills
   windows: a seed (the rest of a cut document, otherwise the unused document of smallest doc_id) is followed by its best
   unused neighbours; what does not fit is cut and seeds the next window. Copies of a text that the window already holds are
   passed over while others are left. So every window but a shard's last is full; the last one's content goes into sequences
   whose lengths are powers of two, which need no padding.

A query is a document's ``terms`` ids of largest weight; when its ``neighbours`` are used up, the last document packed asks
anew, so neither number drops anything. A seed retrieves from its shard: near copies meet there nearly always, documents
that share little with any other meet by chance (see the README for the measured recall).

Nulls: a null text is empty and has the end id alone. Equal rows are packed one by one, told apart by ``row``, the number of
the input row. An empty table gives no pieces. Extra columns are ignored. A text is one row of ids whatever its length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, stash, within
from .textops import U64, blocks, mix, release, tidy
from .tokens import ENCODED, encoder, forget

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long"


@dataclass(frozen=True)
class Packing:
    """terms: a seed's query is its so many terms of largest weight; neighbours: how many a query returns."""

    window: int = 2048
    end_id: int = 1
    shard_tokens: int = 4 << 20
    terms: int = 12
    neighbours: int = 16
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class Corpus:
    """Of all documents: their number, mean length, and the document frequency of every id (one array entry an id)."""

    documents: int
    mean: float
    df: np.ndarray

    @property
    def idf(self) -> np.ndarray:
        return np.log1p((self.documents - self.df + 0.5) / (self.df + 0.5))

    def ranks(self, which: int) -> np.ndarray:
        """A permutation of the ids: in the order of exponential draws (by their hashes) over their idf, those of one document last."""
        unit = ((mix(np.arange(1, len(self.df) + 1, dtype=U64) * U64(2 * which + 3)) >> U64(11)).astype(float) + 0.5) / (1 << 53)
        draw = np.where(self.df > 1, -np.log(unit) / self.idf, np.inf)
        out = np.empty(len(draw), np.int32)
        out[np.argsort(draw, kind="stable")] = np.arange(len(draw))
        return out


class Bm25:
    """An inverted index over documents given as consecutive runs of term numbers."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, p: Packing, corpus: Corpus):
        n, length = len(first) - 1, np.diff(first)
        # a word of eight bytes for each id, and nothing else of that size at a time: two workers share an executor's memory
        pair = np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(32), length)
        np.bitwise_or(pair, ids, out=pair, dtype=np.uint64, casting="unsafe")
        pair.sort()
        at = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))[: len(pair)])
        tf, pair = np.diff(at, append=len(pair)), pair[at]
        self.doc, term = (pair >> np.uint64(32)).astype(np.int32), pair.astype(np.uint32).astype(np.int32)
        del pair, at
        norm = p.k1 * (1 - p.b + p.b * length / max(1.0, corpus.mean))
        weight = corpus.idf[term]
        weight *= tf
        weight *= p.k1 + 1
        weight /= tf + norm[self.doc]
        self.weight = weight.astype(np.float32)
        del weight, tf
        self.term, self.by_doc = term, np.searchsorted(self.doc, np.arange(n + 1, dtype=np.int32))
        order = np.argsort(term, kind="stable")
        self.posting_doc, self.posting_weight = self.doc[order], self.weight[order]
        self.by_term = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=1))))
        self.p = p

    def neighbours(self, seed: int, used: np.ndarray) -> list[int]:
        """Unused documents, best first; ties by number."""
        a, b = self.by_doc[seed], self.by_doc[seed + 1]
        if b - a > self.p.terms:
            top = a + np.argpartition(self.weight[a:b], b - a - self.p.terms)[b - a - self.p.terms :]
        else:
            top = np.arange(a, b)
        slices = [slice(self.by_term[t], self.by_term[t + 1]) for t in np.sort(self.term[top])]
        if not slices:
            return []
        docs = np.concatenate([self.posting_doc[s] for s in slices])
        weights = np.concatenate([self.posting_weight[s] for s in slices])
        score = np.bincount(docs, weights, len(used))
        score[used] = 0
        found = np.flatnonzero(score > 0)
        score = score[found]
        if len(found) > self.p.neighbours:
            least = np.partition(score, len(found) - self.p.neighbours)[len(found) - self.p.neighbours]
            keep = score >= least
            found, score = found[keep], score[keep]
        return found[np.lexsort((found, -score))][: self.p.neighbours].tolist()


def arrange(ids: np.ndarray, first: np.ndarray, same: list, p: Packing, corpus: Corpus) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of all documents; ``ids`` without the end ids, ``same``: a value of
    each document that copies share."""
    size = np.diff(first) + 1
    index, used = Bm25(ids, first, p, corpus), np.zeros(len(size), bool)
    out, sequence, offset, seed_from = [], 0, 0, 0
    queue: list[int] = []
    held: set = set()

    def unused() -> int:
        """The first unused document; rather one of the next ones if the window holds a copy of it."""
        nonlocal seed_from
        while seed_from < len(size) and used[seed_from]:
            seed_from += 1
        for doc in range(seed_from, min(seed_from + 256, len(size))):
            if not used[doc] and same[doc] not in held:
                return doc
        return seed_from

    while True:
        doc = next((d for d in queue if not used[d] and same[d] not in held), None)
        if doc is None:
            doc = unused()
            if doc == len(size):
                break
        used[doc] = True
        held.add(same[doc])
        start, left = 0, int(size[doc])
        while left:
            n = min(left, p.window - offset)
            out.append((doc, start, n, sequence, offset))
            start, left, offset = start + n, left - n, offset + n
            if offset == p.window:
                sequence, offset, queue = sequence + 1, 0, []
                held = {same[doc]} if left else set()
        if offset:
            queue = [d for d in queue if not used[d] and same[d] not in held] or index.neighbours(doc, used)
    if offset:  # the last window's content, again as powers of two
        tail = [x for x in out if x[3] == sequence]
        del out[len(out) - len(tail) :]
        room, filled, bits = 0, 0, [1 << i for i in range(p.window.bit_length(), -1, -1) if offset >> i & 1]
        for doc, start, n, _, _ in tail:
            while n:
                m = min(n, bits[room] - filled)
                out.append((doc, start, m, sequence + room, filled))
                start, n, filled = start + m, n - m, filled + m
                if filled == bits[room]:
                    room, filled = room + 1, 0
    return out


def encoded(docs: DataFrame, tokenizer: str, width: int) -> DataFrame:
    """doc_id, row, n, ids (little-endian, ``width`` bytes each); and for each task one row (row null) of terms and dfs."""
    schema = "doc_id long, row long, n long, ids binary, terms array<int>, dfs array<long>"

    @tidy
    def run(batches):
        encode, df, done = encoder(tokenizer), np.zeros(1 << 16, np.int64), TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, data, offsets in blocks(batch.column(1), ENCODED // 2):  # its scratch stands beside the known pieces
                ids, first = encode(data, offsets)
                m = len(offsets) - 1
                pair = np.sort(np.repeat(np.arange(m, dtype=U64), np.diff(first)) << U64(32) | ids.astype(U64))
                pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))[: len(pair)]]
                more = np.bincount((pair & U64(0xFFFFFFFF)).astype(np.int64))
                if len(more) > len(df):
                    df = np.concatenate((df, np.zeros(2 * len(more) - len(df), np.int64)))
                df[: len(more)] += more
                raw = pa.Array.from_buffers(pa.large_binary(), m, [None, pa.py_buffer(np.ascontiguousarray(first * width, np.int64)), pa.py_buffer(ids.astype(f"<u{width}"))])
                none = pa.nulls(m, pa.list_(pa.int32())), pa.nulls(m, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, m), pa.array(done + np.arange(m)), pa.array(np.diff(first)), raw.cast(pa.binary()), *none], ["doc_id", "row", "n", "ids", "terms", "dfs"])
                done += m
        terms = np.flatnonzero(df)
        if len(terms):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([terms], pa.list_(pa.int32())), pa.array([df[terms]], pa.list_(pa.int64()))], ["doc_id", "row", "n", "ids", "terms", "dfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def corpus_of(rows: DataFrame, vocabulary: int) -> Corpus:
    """Counts over all documents of :func:`encoded`; a number for each id, so no more than the vocabulary is collected."""
    df = np.zeros(vocabulary, np.int64)
    pairs = rows.where("terms is not null").select(F.explode(F.arrays_zip("terms", "dfs")).alias("x"))
    for r in pairs.groupBy("x.terms").agg(F.sum("x.dfs").alias("df")).collect():
        df[r.terms] = r.df
    n, total = rows.where("row is not null").agg(F.count("row"), F.sum("n")).first()
    return Corpus(n, (total or 0) / max(1, n), df)


def dealt(rows: DataFrame, corpus: Corpus, width: int, p: Packing) -> DataFrame:
    """doc_id, row, ids and the shard of every document."""
    ranks, last = (corpus.ranks(0), corpus.ranks(1)), len(corpus.df)

    @tidy
    def run(batches):
        for batch in batches:
            raw = batch.column(2).cast(pa.large_binary())
            first = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] // width
            ids = np.frombuffer(raw.buffers()[2], f"<u{width}")[first[0] : first[-1]] if first[-1] > first[0] else np.zeros(0, int)
            some, keys = np.flatnonzero(np.diff(first)), []
            for r in ranks:
                k = np.full(len(raw), last, np.int32)
                if len(some):
                    k[some] = np.minimum.reduceat(r[ids], first[some] - first[0])
                keys.append(pa.array(k))
            yield pa.RecordBatch.from_arrays([*batch.columns, *keys], ["doc_id", "row", "ids", "n", "a", "b"])

    signed = rows.where("row is not null").select("doc_id", "row", "ids", "n").mapInArrow(run, "doc_id long, row long, ids binary, n long, a int, b int")
    pairs = cut(signed.groupBy("a", "b").agg(F.sum(F.col("n") + 1).alias("size")))
    size = F.lit(p.shard_tokens)
    # a row for each id at most: their sums make one order, which is cut every ``shard_tokens``
    firsts = pairs.groupBy("a").agg(F.sum("size").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = firsts.select(F.col("a").alias("_a"), F.floor(before / size).alias("_at"), F.greatest(F.lit(1), F.floor(F.col("held") / size)).alias("_parts"))
    # pairs that alone fill shards; there are no more of them than shards
    large = pairs.where(F.col("size") > size).select(F.col("a").alias("_la"), F.col("b").alias("_lb"), F.ceil(F.col("size") / size).alias("_more"))
    d = signed.join(F.broadcast(firsts), F.col("a") == F.col("_a")).join(within(large, 1_000_000), (F.col("a") == F.col("_la")) & (F.col("b") == F.col("_lb")), "left")
    spread = F.coalesce(F.pmod(F.xxhash64("row"), F.col("_more")), F.lit(0))
    return d.select("doc_id", "row", "ids", (F.col("_at") + F.pmod(F.xxhash64("b") + spread, F.col("_parts"))).alias("shard"))


def packed(docs: DataFrame, tokenizer: str, params: Packing | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row."""
    from tokenizers import Tokenizer

    p = params or Packing()
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = 2 if vocabulary <= 1 << 16 else 4
    rows = stash(encoded(docs, tokenizer, width))
    corpus = corpus_of(rows, vocabulary)

    def pack(table: pa.Table) -> pa.Table:
        forget()  # the encoder has done its work
        release()
        table = table.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        raw = table.column("ids").combine_chunks().cast(pa.large_binary())
        first = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] // width
        ids = np.frombuffer(raw.buffers()[2], f"<u{width}")[first[0] : first[-1]] if first[-1] > first[0] else np.zeros(0, f"<u{width}")
        first = first - first[0]
        doc_ids, row, shard = table.column("doc_id").combine_chunks(), table.column("row").combine_chunks(), table.column("shard")[0].as_py()
        same = [hash(ids[a:b].tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
        del table
        pieces = arrange(ids, first, same, p, corpus)
        end = np.array([p.end_id], "<u4").tobytes()
        crc = []
        for doc, start, n, _, _ in pieces:
            a, own = first[doc] + start, first[doc + 1]
            body = ids[a : min(a + n, own)].astype("<u4").tobytes()
            crc.append(zlib.crc32(body + end if a + n > own else body))
        col = [np.array(c, np.int64) for c in zip(*pieces, strict=True)]
        out = pa.table(
            {
                "doc_id": doc_ids.take(pa.array(col[0])),
                "start": col[1],
                "length": col[2],
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": np.diff(first)[col[0]] + 1,
                "sequence_id": col[3] + (shard << 32),
                "offset": col[4],
                "row": row.take(pa.array(col[0])),
            }
        )
        del raw, ids, pieces, col
        release()
        return out

    return dealt(rows, corpus, width, p).groupBy("shard").applyInArrow(pack, SCHEMA)


def op10_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, documents(spark, sf_dir), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents of ``docs`` as :func:`packed` gives them; the cases are those of the module."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))
