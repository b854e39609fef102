"""Nucleotide and protein sequences: everything here stays on the JVM side but the windowed minimizer and packed k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUCLEOTIDE = "^[ATGCNatgcn]+$"
PROTEIN = r"^[A-Za-z*\-]+$"

# The NCBI genetic codes, amino acids in the order TTT, TTC, TTA, TTG, TCT, ... of bases T, C, A, G.
CODES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    3: "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    4: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    5: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    6: "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    9: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    10: "FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    11: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    12: "FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    13: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG",
    14: "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    16: "FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    21: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    22: "FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    23: "FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    24: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG",
    25: "FFLLSSSSYY**CCGWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    26: "FFLLSSSSYY**CC*WLLLAPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    27: "FFLLSSSSYYQQCCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    28: "FFLLSSSSYYQQCCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    29: "FFLLSSSSYYYYCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    30: "FFLLSSSSYYEECC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    31: "FFLLSSSSYYEECCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    33: "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG",
}
# The IUPAC letters that stand for several bases, and for one of two amino acids.
AMBIGUOUS = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
EITHER = {"DN": "B", "EQ": "Z", "IL": "J"}


def gc_percent(seq: Column) -> Column:
    """(G + C) * 100 / (A + C + G + T) in either case; null if there is none of them."""
    return F.regexp_count(seq, F.lit("[GCgc]")) * F.lit(100.0) / F.nullif(F.regexp_count(seq, F.lit("[ACGTacgt]")), F.lit(0))


def mean_quality(qual: Column) -> Column:
    """Arithmetic mean of the Phred values (offset 33); null for an empty string."""
    codes = F.transform(F.split(qual, ""), F.ascii)
    return F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.length(qual), F.lit(0)) - 33


def n_count(seq: Column) -> Column:
    return F.regexp_count(seq, F.lit("N"))


def mask_n(seq: Column) -> Column:
    """Every run of letters other than A, G, C, T becomes one N."""
    return F.regexp_replace(seq, "[^AGCT]+", "N")


def reverse_complement(seq: Column) -> Column:
    """Other letters than ACGT pass through."""
    return F.reverse(F.translate(seq, "ATGCatgc", "TACGtacg"))


def slice_strand(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """The span start..end (1-based, inclusive), reverse-complemented on the reverse strand."""
    part = F.substring(seq, start.cast("int"), (end - start + 1).cast("int"))
    return F.when(strand < 0, reverse_complement(part)).otherwise(part)


def translate(seq: Column, table: Column) -> Column:
    """Amino acids by the genetic code of number ``table`` (null for an unknown number), trailing stops removed.

    A codon with ambiguous letters is the amino acid that all its readings share (B, Z or J for the pairs of EITHER),
    otherwise X, as is one with any other letter; letters beyond the last whole codon are dropped. The codons are cut by one
    scan, so the work is linear in the length.
    """
    codons = F.regexp_extract_all(F.translate(F.upper(seq), "U", "T"), F.lit("(?s)(...)"), 1)
    codes = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))
    letters = F.create_map(*(F.lit(x) for kv in AMBIGUOUS.items() for x in kv))

    def with_code(code: Column) -> Column:
        def amino(codon: Column) -> Column:
            at = F.lit(0)
            for k in range(3):
                at = at * 4 + F.nullif(F.instr(F.lit("TCAG"), F.substring(codon, k + 1, 1)), F.lit(0)) - 1
            return F.coalesce(F.substring(code, at + 1, F.lit(1)), ambiguous(codon), F.lit("X"))

        def ambiguous(codon: Column) -> Column:
            bases = [F.split(letters[F.substring(codon, k + 1, 1)], "") for k in range(3)]
            place = lambda c: F.instr(F.lit("TCAG"), c) - 1
            one = lambda a, b, c: F.substring(code, place(a) * 16 + place(b) * 4 + place(c) + 1, F.lit(1))
            readings = F.flatten(F.transform(bases[0], lambda a: F.flatten(F.transform(bases[1], lambda b: F.transform(bases[2], lambda c: one(a, b, c))))))
            shared = F.array_join(F.array_sort(F.array_distinct(readings)), "")
            out = F.when(F.length(shared) == 1, shared)
            for two, letter in EITHER.items():
                out = out.when(shared == two, F.lit(letter))
            return out

        return F.when(code.isNotNull() & seq.isNotNull(), F.rtrim(F.array_join(F.transform(codons, amino), ""), F.lit("*")))

    return F.get(F.transform(F.array(codes[table.cast("int")]), with_code), F.lit(0))


def canonical_kmers(seq: Column, k: int) -> Column:
    """All canonical k-mers (the greater of a k-mer and its reverse complement) of ACGT letters, in order, upper case.

    A lookahead yields every overlapping window in one scan; windows with other letters do not match. The reverse
    complement is made once: its windows, from the last to the first, are those of the k-mers.
    """
    parts = lambda s: F.regexp_extract_all(s, F.lit(f"(?=([ACGT]{{{k}}}))"), 1)
    upper = F.upper(seq)
    return F.zip_with(parts(upper), F.reverse(parts(reverse_complement(upper))), lambda x, y: F.greatest(x, y))


def distinct_kmers(seq: Column, k: int) -> Column:
    """The distinct canonical k-mers of a sequence, in the order in which they come up first."""
    return F.array_distinct(canonical_kmers(seq, k))


def kmers(seq: Column, k: int) -> Column:
    """The distinct canonical k-mers of a sequence, sorted."""
    return F.array_sort(distinct_kmers(seq, k))


def pair_name(name: Column) -> Column:
    return F.substring_index(name, "/", 1)


def hash64(x: np.ndarray) -> np.ndarray:
    """Thomas Wang's 64-bit integer hash, in wrapping arithmetic."""
    u = np.uint64
    x = ~x + (x << u(21))
    x = x ^ (x >> u(24))
    x = x + (x << u(3)) + (x << u(8))
    x = x ^ (x >> u(14))
    x = x + (x << u(2)) + (x << u(4))
    x = x ^ (x >> u(28))
    return x + (x << u(31))


_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def minimizer_codes(seq: str | None, k: int, w: int) -> list[int]:
    """Sorted distinct signed hash codes of the minimizers of windows of ``w`` k-mers.

    The smallest code of a window is taken (the last of equal ones), and the next window starts after it; a last window
    of fewer than ``w`` k-mers gives none.
    """
    code = _CODE[np.frombuffer((seq or "").encode("ascii", "replace"), np.uint8)]
    n = len(code) - k + 1
    if n < 1:
        return []
    u = np.uint64
    forward, backward = np.zeros(n, u), np.zeros(n, u)
    for j in range(k):
        c = code[j : j + n].astype(u)
        forward = (forward << u(2)) | (c & u(3))
        backward |= (u(3) - (c & u(3))) << u(2 * j) if 2 * j < 64 else u(0)
    bad = np.concatenate(([0], np.cumsum(code == 4)))
    mask = u((1 << (2 * k)) - 1) if 2 * k < 64 else u(0xFFFFFFFFFFFFFFFF)
    canonical = np.maximum((forward & mask).view(np.int64), (backward & mask).view(np.int64)).view(u)
    h = hash64(canonical[bad[k:] == bad[:n]]).view(np.int64)
    if w <= 1:
        return np.unique(h).tolist()
    out, start = set(), 0
    while start + w <= len(h):
        window = h[start : start + w]
        best = w - 1 - int(np.argmin(window[::-1]))
        out.add(int(window[best]))
        start += best + 1
    return sorted(out)


def minimizers(seq: Column, k: int, w: int) -> Column:
    """array<long> of :func:`minimizer_codes`; its windows depend on each other, so it runs in Arrow batches."""

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: minimizer_codes(x, k, w))

    return run(seq)


def batch_codes(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow text column: the distinct canonical k-mers (k <= 31) of each row as numbers of 2 bits a letter, ascending,
    and their rows. The order of numbers is that of the strings; a window that leaves its sequence or holds another letter
    than ACGT in either case gives none."""
    u = np.uint64
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if offsets[-1] - offsets[0] < k:
        return np.zeros(0, u), np.zeros(0, np.int64)
    code = _CODE[np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    bad = np.concatenate(([0], np.cumsum(code == 4, dtype=np.int64)))
    at = np.flatnonzero(bad[k:] == bad[: len(code) - k + 1])
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + k <= offsets[row + 1]
    at, row = at[inside], row[inside]
    forward, backward = np.zeros(len(at), u), np.zeros(len(at), u)
    for j in range(k):
        c = code[at + j].astype(u)
        forward = forward << u(2) | c
        backward |= (u(3) - c) << u(2 * j)
    c = np.maximum(forward, backward)
    order = np.lexsort((c, row))
    c, row = c[order], row[order]
    first = np.ones(len(c), bool)
    first[1:] = (c[1:] != c[:-1]) | (row[1:] != row[:-1])
    return c[first], row[first]


def kmer_codes(rows: DataFrame, seq: str, k: int) -> DataFrame:
    """code: the distinct canonical k-mers of each row's sequence, as :func:`batch_codes` gives them, a row each."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(batch_codes(batch.column(0), k)[0].view(np.int64))], ["code"])

    return rows.select(seq).mapInArrow(run, "code long")


def packed_kmers(seq: Column, k: int) -> Column:
    """array<long> of the distinct canonical k-mers (k <= 31)."""

    @F.arrow_udf("array<bigint>")
    def run(column: pa.Array) -> pa.Array:
        code, row = batch_codes(column, k)
        offsets = np.searchsorted(row, np.arange(len(column) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(code.view(np.int64)))

    return run(seq)


def kmer_strings(rows: DataFrame, k: int) -> DataFrame:
    """kmer, kmer_count of ``code``, ``kmer_count``."""

    def run(batches):
        letters = np.frombuffer(b"ACGT", np.uint8)
        for batch in batches:
            code = batch.column(0).to_numpy().view(np.uint64)
            text = np.stack([letters[(code >> np.uint64(2 * (k - 1 - j)) & np.uint64(3)).astype(np.int64)] for j in range(k)], axis=1)
            offsets = pa.py_buffer(np.arange(len(code) + 1, dtype=np.int32) * np.int32(k))
            yield pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(len(code), offsets, pa.py_buffer(np.ascontiguousarray(text))), batch.column(1)], ["kmer", "kmer_count"])

    return rows.select("code", "kmer_count").mapInArrow(run, "kmer string, kmer_count long")
