"""Operator 1: language-model scoring by cross-entropy difference.

Two bigram models, one of a target sample and one of the background corpus, over every word of both (A-Z lower-cased).
Both have the same form and share the vocabulary, P(b|a) = lam * c(a b) / c(a) + (1 - lam) * (c(b) + 1) / (N + V), where the
start of a text is the ``a`` of its first word and its end follows its last one. N counts words, V the distinct words of both
samples and one symbol for all others; c(a) = 0 gives the second term alone. A document's score is its mean loss under the target model less that under the background model: low
scores are like the target. A document that is itself part of a model is scored without its own counts (leave-one-out),
so that neither model remembers it.

The models are a table of counts by key (a bigram or a word), dealt by ranges of the key's hash; it grows with the corpus
and is never collected nor broadcast. Documents are dealt to groups of about ``group_bytes`` of text by their id's hash. A
group sends each range its sorted keys and counts, as one packed row; a range adds up what all groups sent and
answers each with the totals of its own keys, in their order; there the texts are scored. So a key has one entry for
each group, however hot it is. Documents of an id with more than ``group_bytes`` of text are dealt further.

Nulls and blank texts have no tokens and null losses and score. Target rows need not be in the corpus. An empty target
gives the add-one model. Repeated rows count again and are scored each. Words and bigrams are identified by 63 bits of
hash. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels, stash, within
from .textops import U64, blocks, mix, release, span_hashes, spans


@dataclass(frozen=True)
class Bigrams:
    """group_bytes: text of a group; range_bytes: text whose keys, dealt evenly, make one range."""

    lam: float = 0.7
    group_bytes: int = 8 << 20
    range_bytes: int = 12 << 20


#: The low bit of a key tells its kind.
PAIR, WORD = U64(0), U64(1)
#: What a row of a group is: a document to score, a text of the target or of a background of its own, the doc_id of a
#: document that is in the target.
DOC, TARGET, BACKGROUND, LABEL = range(4)
_START = U64(0x5851F42D4C957F2D)


def narrow(x: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs; the first byte tells how many."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(raw: bytes) -> np.ndarray:
    width = raw[0]
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").ravel()


def tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words, keys of the bigrams that end in them, and how many words each text has."""
    word, pair, counts = [], [], []
    for _, data, offsets in blocks(texts):
        starts, ends, first = spans(data, offsets)
        b = span_hashes(data, starts, ends, lower=True)
        n = np.diff(first)
        a = np.concatenate((np.zeros(1, U64), b[:-1]))[: len(b)]
        a[first[:-1][n > 0]] = _START
        word.append(b | WORD)
        pair.append(mix(mix(a + U64(0x9E3779B97F4A7C15)) * U64(0xD6E8FEB86659FD93) + b) & ~WORD)
        counts.append(n)
    if not counts:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(word), np.concatenate(pair), np.concatenate(counts)


class Group:
    """The tokens of a group's rows and their distinct keys in ascending order; ``at``: each token's place among the keys."""

    def __init__(self, table: pa.Table, own: bool):
        word, pair, self.n = tokens(table.column("text"))
        code, unique = pd.factorize(np.concatenate((word, pair)))
        order = np.argsort(unique)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.keys, (self.word, self.pair) = unique[order], rank[code].reshape(2, -1)
        kind, ids = table.column("kind").to_numpy(), table.column("doc_id")
        marked = pc.is_in(ids, value_set=ids.filter(pa.array(kind == LABEL)).combine_chunks().drop_null()).to_numpy(zero_copy_only=False)
        self.kind = kind
        #: whether a row's text is counted in the background and in the target model
        self.counted = (kind == (DOC if own else BACKGROUND)), (kind == TARGET) | (kind == DOC) & marked

    def counts(self) -> list[np.ndarray]:
        out = []
        for rows in self.counted:
            of = np.repeat(rows, self.n)
            out.append(np.bincount(self.word[of], minlength=len(self.keys)) + np.bincount(self.pair[of], minlength=len(self.keys)))
        return out

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each token's word, and the bigram that ends in it, occur in its text."""
        doc = np.repeat(np.arange(len(self.n)) * len(self.keys), self.n)
        out = []
        for at in (self.word, self.pair):
            code, unique = pd.factorize(doc + at)
            out.append(np.bincount(code, minlength=len(unique))[code])
        return tuple(out)

    def before(self, x: np.ndarray, start) -> np.ndarray:
        """``x`` of each token's preceding token, ``start`` (one value a row) of each text's first."""
        out = np.concatenate((x[:1], x[:-1]))[: len(x)]
        some = np.flatnonzero(self.n)
        out[(np.cumsum(self.n) - self.n)[some]] = start[some]
        return out


def score(docs: DataFrame, target: DataFrame, params: Bigrams | None = None, background: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (their difference) for each row of ``docs``.

    ``target``: texts of the target domain, or (without a column ``text``) doc_ids of those of ``docs`` that make it;
    ``background``: texts of the corpus, ``docs`` if not given.
    """
    p = params or Bigrams()
    own, by_id = background is None, "text" not in target.columns
    long, none = F.col("doc_id").cast("long").alias("doc_id"), F.lit(None)
    rows = docs.select(long, "text", F.lit(DOC).alias("kind"))
    if not by_id:
        rows = rows.union(target.select(none.cast("long"), "text", F.lit(TARGET)))
    if not own:
        rows = rows.union(background.select(none.cast("long"), "text", F.lit(BACKGROUND)))
    held = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    total = held.agg(F.sum("bytes")).first()[0] or 0
    groups, ranges, lam = max(1, -(-total // p.group_bytes)), max(1, -(-total // p.range_bytes)), p.lam

    # an id with much text (there are no more of them than groups) is dealt by its rows, and its label goes to all of these
    large = within(held.where(F.col("bytes") > p.group_bytes).select(F.col("doc_id").alias("_id"), F.ceil(F.col("bytes") / p.group_bytes).alias("_parts")), 100_000)
    place = lambda part: F.pmod(F.xxhash64("doc_id", part), F.lit(groups)).cast("int")
    rows = rows.join(large, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("text", F.spark_partition_id()), F.col("_parts"))).otherwise(F.lit(0).cast("long"))
    dealt = rows.select("doc_id", "text", "kind", place(part).alias("g"))
    if by_id:
        marks = target.select(long).distinct().join(large, F.col("doc_id") == F.col("_id"), "left")
        marks = marks.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)) - 1)).alias("_part"))
        dealt = dealt.union(marks.select("doc_id", none.cast("string"), F.lit(LABEL), place(F.col("_part"))))

    def send(table: pa.Table) -> pa.Table:
        x = Group(table, own)
        counts = x.counts()
        # ranges of equal width: the keys' upper halves, scaled
        place = ((x.keys >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(place, prepend=-1))
        out = {"r": place[cut].astype(np.int32), "g": np.full(len(cut), table.column("g")[0].as_py(), np.int32), "keys": [], "n": [], "t": []}
        for a, b in zip(cut, np.append(cut[1:], len(place)), strict=False):  # none, if there are no keys
            out["keys"].append(x.keys[a].tobytes() + narrow(np.diff(x.keys[a:b])))
            out["n"].append(narrow(counts[0][a:b]))
            out["t"].append(narrow(counts[1][a:b]))
        for name, rows_ in zip(("starts_n", "starts_t"), x.counted, strict=True):  # counted once, with a group's first row
            out[name] = np.where(np.arange(len(cut)) == 0, np.count_nonzero(rows_ & (x.n > 0)), 0)
        out = pa.table({k: pa.array(v, pa.binary()) if isinstance(v, list) else v for k, v in out.items()})
        del x, counts, place
        release()
        return out

    def answer(table: pa.Table) -> pa.Table:
        keys = []
        for raw in table.column("keys").to_pylist():
            keys.append(np.cumsum(np.concatenate((np.frombuffer(raw, U64, 1), widen(raw[8:]))), dtype=U64))
        size = np.cumsum([0, *map(len, keys)])
        code, unique = pd.factorize(np.concatenate(keys))
        del keys
        is_word = unique & WORD == WORD
        alone = np.arange(len(table)) == 0  # a range's own numbers go with its first row
        out, seen = {"g": table.column("g"), "r": table.column("r")}, np.zeros(len(unique), bool)
        for name in ("n", "t"):
            own_ = np.concatenate([widen(x) for x in table.column(name).to_pylist()]).astype(np.int64)
            sums = np.bincount(code, own_, len(unique)).astype(np.int64)
            out[f"all_{name}"], out[f"starts_{name}"] = np.where(alone, sums[is_word].sum(), 0), table.column(f"starts_{name}")
            seen |= sums > 0
            sums = sums[code]
            out[name] = pa.array([narrow(sums[a:b]) for a, b in zip(size[:-1], size[1:], strict=True)], pa.binary())
        out = pa.table(out | {"words": np.where(alone, (is_word & seen).sum(), 0)})
        del code, unique, sums, own_
        release()
        return out

    sent = dealt.groupBy("g").applyInArrow(send, "r int, g int, keys binary, n binary, t binary, starts_n long, starts_t long")
    numbers = ["words", "all_n", "all_t", "starts_n", "starts_t"]
    columns = ["g", "r", "words", "all_n", "starts_n", "n", "all_t", "starts_t", "t"]
    totals = stash(sent.groupBy("r").applyInArrow(lambda t: answer(t).select(columns), "g int, r int, words long, all_n long, starts_n long, n binary, all_t long, starts_t long, t binary"))
    distinct, all_n, all_t, first_n, first_t = (x or 0 for x in totals.agg(*(F.sum(c) for c in numbers)).first())
    symbols = 1 + distinct  # one stands for words of neither sample

    def losses(table: pa.Table, model: pa.Table) -> pa.Table:
        x = Group(table, own)
        model = model.sort_by("r")
        some, first, out = np.flatnonzero(x.n), np.cumsum(x.n) - x.n, []
        own_word, own_pair = x.own()
        for name, total_, first_, counted in (("t", all_t, first_t, x.counted[1]), ("n", all_n, first_n, x.counted[0])):
            c = np.concatenate([np.zeros(0, U64), *(widen(v) for v in model.column(name).to_pylist())]).astype(np.float64)
            less = np.repeat(counted, x.n)  # tokens whose text is in the model: less its own counts
            mean = np.full(len(x.n), np.nan)
            if len(some):
                word = c[x.word] - less * own_word
                head = x.before(word, np.full(len(x.n), float(first_)) - counted)
                base = (word + 1) / (total_ - np.repeat(counted * x.n, x.n) + symbols)
                prob = np.where(head > 0, lam * (c[x.pair] - less * own_pair) / np.maximum(head, 1) + (1 - lam) * base, base)
                mean[some] = np.add.reduceat(-np.log(prob), first[some]) / x.n[some]
            out.append(mean)
        none_ = x.n == 0
        columns = [table.column("doc_id"), pa.array(x.n, pa.int64()), *(pa.array(m, pa.float64(), mask=none_) for m in (*out, out[0] - out[1]))]
        result = pa.table(columns, ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]).filter(pa.array(x.kind == DOC))
        del x, own_word, own_pair
        release()
        return result

    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    return dealt.groupBy("g").cogroup(totals.select("g", "r", "n", "t").groupBy("g")).applyInArrow(losses, schema)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the good and not toxic labelled documents, the background all documents."""
    good = labels(spark, sf_dir).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0")
    return score(documents(spark, sf_dir), good.select("doc_id"))
