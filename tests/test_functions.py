import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import loc, register, variant, vec
from strandlake.functions import seq as S


def one(spark, **columns):
    """The values of expressions over one row."""
    r = spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()
    return r if len(columns) > 1 else r[0]


def test_gc_quality_masks(spark):
    r = one(spark, a=S.gc_percent(F.lit("ATGCn")), b=S.gc_percent(F.lit("NN")), c=S.gc_percent(F.lit(None).cast("string")), d=S.mean_quality(F.lit("I!5")), e=S.mean_quality(F.lit("")), f=S.n_count(F.lit("NnANN")), g=S.mask_n(F.lit("ANNxT")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == (50.0, None, None, pytest.approx((40 + 0 + 20) / 3), None, 3, "ANT")


def test_slices_and_translation(spark):
    contig = F.lit("ATGC" * 1000)
    part = S.slice_strand(contig, F.lit(1), F.lit(12), F.lit(-1))
    r = one(spark, a=part, b=S.translate(part, F.lit(11)), c=S.translate(F.lit("ATGTGATAA"), F.lit(2)), d=S.translate(F.lit("atgnnnccaTA"), F.lit(1)), e=S.translate(F.lit("ATG"), F.lit(-1)), f=S.translate(F.lit(""), F.lit(1)), g=S.reverse_complement(F.lit("AcgN")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("GCATGCATGCAT", "ACMH", "MW", "MXP", None, "", "NcgT")
    assert all(len(c) == 64 for c in S.CODES.values())


def literal_minimizers(seq, k, w):
    """The windows by plain loops over k-mers."""
    flip, code = str.maketrans("ACGT", "TGCA"), {c: i for i, c in enumerate("ACGT")}

    def value(x):
        n = 0
        for c in x:
            n = n * 4 + code[c]
        return n

    def h(x):
        m = (1 << 64) - 1
        x = (~x + (x << 21)) & m
        x ^= x >> 24
        x = (x + (x << 3) + (x << 8)) & m
        x ^= x >> 14
        x = (x + (x << 2) + (x << 4)) & m
        x ^= x >> 28
        x = (x + (x << 31)) & m
        return x - (1 << 64) if x >> 63 else x

    s = seq.upper()
    codes = [h(max(value(x), value(x.translate(flip)[::-1]))) for x in (s[i : i + k] for i in range(len(s) - k + 1)) if set(x) <= set("ACGT")]
    out, at = set(), 0
    while at + w <= len(codes):
        best = min(range(w), key=lambda j: (codes[at + j], -j))
        out.add(codes[at + best])
        at += best + 1
    return sorted(out)


@pytest.mark.parametrize("k,w", [(3, 1), (5, 4), (15, 16), (31, 1)])
def test_minimizers(k, w):
    random.seed(k)
    for n in (0, k - 1, k, 60, 300):
        s = "".join(random.choice("ACGTacgtN" if n == 300 else "ACGT") for _ in range(n))
        assert S.minimizer_codes(s, k, w) == literal_minimizers(s, k, w)
    assert S.minimizer_codes(None, k, w) == []


def test_kmers(spark):
    random.seed(4)
    flip = str.maketrans("ACGT", "TGCA")
    for s in ("ACG", "ACGTNACGTT", "aacgttACGTT", "".join(random.choice("ACGTN") for _ in range(200))):
        u = s.upper()
        want = {max(x, x.translate(flip)[::-1]) for x in (u[i : i + 4] for i in range(len(u) - 3)) if set(x) <= set("ACGT")}
        assert one(spark, a=S.kmers(F.lit(s), 4)) == sorted(want)
    codes = one(spark, a=S.minimizers(F.lit("ACGTTGCAACGT"), 3, 2))
    assert list(codes) == literal_minimizers("ACGTTGCAACGT", 3, 2)


def test_locations_and_qualifiers(spark):
    seg = lambda a, b, s: F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(s).cast("tinyint").alias("strand"))
    e = one(spark, a=loc.envelope(F.array(seg(300, 350, -1), seg(200, 250, -1), seg(1, 150, -1))))
    assert (e.start, e.end, e.strand) == (1, 350, -1)
    assert one(spark, a=loc.envelope(F.array(seg(1, 2, 1), seg(3, 4, -1)))).strand == 0
    assert one(spark, a=loc.envelope(F.array().cast("array<struct<start:bigint,end:bigint,strand:tinyint>>"))) is None
    q = F.array(F.struct(F.lit("a").alias("key"), F.array(F.lit("1"), F.lit("2")).alias("values")), F.struct(F.lit("b").alias("key"), F.array(F.lit("x")).alias("values")))
    r = one(spark, a=loc.qualifier(q, "a"), b=loc.numeric_qualifier(q, "b"), c=loc.qualifier(q, "zz"), d=F.size(loc.other_qualifiers(q, "a")))
    assert (r.a, r.b, r.c, r.d) == ("1", None, None, 1)


def test_vectors(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    none = F.lit(None).cast("array<double>")
    r = one(spark, a=vec.cosine(v(1, 0), v(1, 1)), b=vec.cosine(v(0, 0), v(0, 0)), c=vec.cosine(v(0, 0), v(1, 0)), d=vec.cosine(v(1), v(1, 2)), e=vec.cosine(none, v(1)), f=vec.euclid_similarity(v(0, 0), v(3, 4)), g=vec.similarity(v(1), v(1), "other"))
    assert r.a == pytest.approx(2**-0.5) and (r.b, r.d, r.e, r.f, r.g) == (0, 0, 0, -4, 0) and r.c != r.c
    m = lambda **kv: F.create_map(*(F.lit(x) for k, v in kv.items() for x in (k, float(v))))
    r = one(spark, a=vec.l2_normalize(m(x=3, y=4)), b=vec.l2_normalize(m(x=0)), c=vec.sparse_distance(m(x=1, y=2), m(y=2, z=2)))
    assert r.a == {"x": 0.6, "y": 0.8} and r.b == {"x": None} and r.c == pytest.approx(5**0.5)


def test_variants(spark):
    names = ["NC_000007.13", "chr7", "7", "X", "chrM", "MT", "26", "scaffold_1", ".", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(variant.chromosome_number(F.col("n"))).collect()]
    assert got == [7, 7, 7, 23, 25, 25, None, None, None, None]
    gts = ["0|1", "1/1", "1", ".", "./.", "2|1:35:99", None]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in gts], "g string").select(variant.genotype_alleles(F.col("g"))).collect()]
    assert got == [[0, 1], [1, 1], [1], [0], [0, 0], [2, 1], None]
    assert one(spark, a=variant.rs_number(F.lit("rs12")), b=variant.rs_number(F.lit("."))) == (12, None)


def test_sql_functions(spark):
    assert "vec_cosine" in register(spark)
    r = spark.sql("SELECT gc_percent('GGAA') a, vec_euclid(array(0D, 0D), array(3D, 4D)) b, reverse_complement('AAC') c, l2_normalize(map('x', 2D))['x'] d, mean_quality('I') e").first()
    assert tuple(r) == (50.0, -4.0, "GTT", 1.0, 40.0)


def test_ambiguous_codons(spark):
    assert one(spark, a=S.translate(F.lit("GCNRAYSARATHTARNNNACG"), F.lit(1))) == "ABZI*XT"
