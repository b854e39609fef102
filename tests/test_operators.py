import random
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import runner, streaming
from strandlake.operators import annotation, dedup, features, genotype, graph
from strandlake.operators import reads as R
from strandlake.plans import risk
from strandlake.plans.clusters import ClusterDatabase, GenomeDatabase, gathering_cutoffs, profile_names, scan_domains
from strandlake.sources.formats import Fasta
from strandlake.table import Nucleotides

BOX = "struct<start:bigint,end:bigint,start_partial:boolean,end_partial:boolean,strand:tinyint>"
FEATURES = f"file_path string, source_path string, seq_id string, type string, location array<{BOX}>, qualifiers array<struct<key:string,values:array<string>>>"


def feature(kind, a, b, strand, **q):
    return ("f", "f", "c", kind, [(a, b, False, False, strand)], [(k, v if isinstance(v, list) else [v]) for k, v in q.items()])


def contigs(spark):
    return Nucleotides(spark.createDataFrame([("f", "c", "", "ATGC" * 1000, 4000)], "file_path string, seq_id string, desc string, sequence string, length long"))


def test_cds_and_clusters(spark):
    f = spark.createDataFrame(
        [
            feature("CDS", 1, 12, -1, locus_tag="t", transl_table="11", extra="x"),
            feature("CDS", 1, 12, -1, translation="OLD", transl_table="x"),
            feature("region", 1, 100, 1, product=["PKS", "NRPS"], contig_edge="False"),
            feature("cluster", 3950, 4000, 1, BGC_Class="A"),
            feature("cluster", 1, 50, 1),
        ],
        FEATURES,
    )
    cds = annotation.cds_from_features(f)
    got = {r.locus_tag: r for r in annotation.translate_cds(cds, contigs(spark).df).collect()}
    assert got["t"].aa_sequence == "ACMH" and [q.key for q in got["t"].other_qualifiers] == ["extra"] and got[None].aa_sequence == "OLD" and got[None].transl_table is None
    every = annotation.translate_cds(cds, contigs(spark).df, translate_all=True, default_table=11).collect()
    assert {r.aa_sequence for r in every} == {"ACMH"}
    a = annotation.clusters_from_features(f).collect()
    assert len(a) == 1 and a[0].classes == ["PKS", "NRPS"] and a[0].on_contig_edge is False
    s = annotation.fill_clusters(annotation.clusters_from_features(f, "smc"), contigs(spark).df, check_edges=True).collect()
    assert len(s) == 1 and s[0].on_contig_edge is True and len(s[0].nt_seq) == 51
    assert annotation.clusters_from_features(f, "custom", "cluster", "BGC_Class").count() == 1
    with pytest.raises(ValueError):
        annotation.clusters_from_features(f, "custom")
    with pytest.raises(NotImplementedError):
        annotation.clusters_from_features(f, "other")


@pytest.mark.parametrize("bin_size", [None, 7, 1000])
def test_containment(spark, bin_size):
    outer, inner = [(i, i % 2, i * 5, i * 5 + i % 23) for i in range(40)], [(i, i % 2, i * 3, i * 3 + i % 4) for i in range(70)]
    ddl = "id long, key long, start long, end long"
    got = annotation.contained(spark.createDataFrame(outer, ddl), spark.createDataFrame(inner, ddl), ["key"], "start", "end", bin_size).collect()
    want = sorted((a[0], b[0]) for a in outer for b in inner if a[1] == b[1] and a[2] <= b[2] and a[3] >= b[3])
    assert sorted((r.o_id, r.i_id) for r in got) == want


def test_cluster_database(spark, tmp_path):
    f = spark.createDataFrame([feature("CDS", 1, 12, 1, locus_tag="a"), feature("CDS", 20, 31, 1, locus_tag="b"), feature("CDS", 200, 211, 1, locus_tag="c"), feature("region", 1, 100, 1, product="PKS"), feature("region", 15, 90, 1, product="NRPS")], FEATURES)
    db = ClusterDatabase.create(spark, f"{tmp_path}/db", features=f, contigs=contigs(spark).df)
    again = ClusterDatabase.get_or_create(spark, f"{tmp_path}/db")
    assert again.facts == {"source": "antismash"} and again.get("cds").df.count() == 3 and again.members().count() == 3
    with pytest.raises(FileExistsError):
        ClusterDatabase.create(spark, f"{tmp_path}/db", features=f)
    with pytest.raises(TypeError):
        GenomeDatabase.load(spark, f"{tmp_path}/db")
    with pytest.raises(FileNotFoundError):
        ClusterDatabase.load(spark, f"{tmp_path}/none")

    def scorer():
        return lambda s: [(1, len(s), "PF1", "one", 50.0), (1, 2, "PF2", "two", 5.0)]

    hits = scan_domains(db.get("cds").df, scorer)
    sub = hits.where("hmm_acc = 'PF1'").withColumn("hmm_name", F.lit("one.aligned_c3"))
    cuts = spark.createDataFrame([("PF1", 10.0), ("PF2", 10.0)], "hmm_acc string, cutoff double")
    v = db.vectors(hits, sub, cutoffs=cuts)
    assert [r.features for r in v.collect()] == [{"PF1": 255.0, "one.aligned_c3": 255.0}] * 2
    m = db.membership(v, 0.4, 1)
    assert m.count() == 2 and m.select("gcf_id").distinct().count() == 1 and db.membership(v, 0.4, 1).count() == 2
    assert profile_names("NAME x\nACC PF2.1\nGA 20.5 20.5;\n//\nNAME a\n//\n") == ["PF2.1", "a"] and gathering_cutoffs("NAME x\nACC PF2.1\nGA 20.5 20.5;\n//\n") == [("PF2.1", 20.5)]
    genome = GenomeDatabase.create(spark, f"{tmp_path}/g", contigs=contigs(spark), features=f)
    assert genome.count_cds().first()["count"] == 3


def test_vectors_and_families(spark):
    hits = spark.createDataFrame([(1, "f", "m1", 9.0), (1, "f", "m2", 8.0), (1, "f", "m3", 8.0), (1, "f", "m4", 1.0)], "q long, fam string, member string, bitscore double")
    assert {r.member: r.value for r in features.ranked_features(hits, ["q"], "fam", "member", 3).collect()} == {"m1": 255.0, "m2": 170.0, "m3": 85.0}
    v = spark.createDataFrame([(1, {"a": 1.0}), (2, {"a": 2.0, "b": 0.1}), (3, {"c": 5.0}), (4, {"z": 0.0})], "bgc_id long, features map<string,double>")
    c = features.centroids(v.where("bgc_id < 4"), 0.3, 1)
    assert c.count() == 2
    near = {r.bgc_id: r for r in features.nearest(v.where("bgc_id < 4"), c).collect()}
    assert near[1].gcf_id == near[2].gcf_id != near[3].gcf_id and near[3].dist == pytest.approx(0, abs=1e-6)
    far = spark.createDataFrame([(9, {"q": 1.0})], "bgc_id long, features map<string,double>")
    assert features.nearest(far, c).count() == 1
    assert [n for n, _ in features.flat_birch([{"a": 1.0}, {"a": 1.1}, {"b": 1.0}, {"a": 1.0}], 0.4)] == [3, 1]


def literal_birch(points, threshold):
    """Flat BIRCH in exact arithmetic, a sub-cluster at a time."""
    made = []
    for p in points:
        p = {k: Fraction(v) for k, v in p.items()}
        own = sum(v * v for v in p.values())
        if made:
            n, total, square = near = min(made, key=lambda c: sum((c[1].get(k, 0) / c[0] - p.get(k, 0)) ** 2 for k in c[1].keys() | p.keys()))
            merged = {k: total.get(k, 0) + p.get(k, 0) for k in total.keys() | p.keys()}
            if (square + own) / (n + 1) - sum((v / (n + 1)) ** 2 for v in merged.values()) <= Fraction(threshold) ** 2:
                near[:] = n + 1, merged, square + own
                continue
        made.append([1, p, own])
    return [(n, {k: float(v / n) for k, v in total.items() if v > 0}) for n, total, _ in made]


@pytest.mark.parametrize("block,slab", [(256, 1024), (3, 2)])
def test_birch_by_blocks(block, slab, monkeypatch):
    """Blocks of points give what one point after another gives, ties and empty points included."""
    monkeypatch.setattr(features, "BLOCK", block)
    monkeypatch.setattr(features, "SLAB", slab)
    random.seed(block)
    for width, threshold in ((1, 0.3123), (3, 0.5123), (8, 0.7712), (40, 0.9123)):
        points = [{f"k{random.randrange(width)}": random.choice([1.0, 0.5, -1.0, 0.0, 0.125]) for _ in range(random.randint(0, 4))} for _ in range(70)]
        got, want = features.flat_birch(points, threshold), literal_birch(points, threshold)
        assert [n for n, _ in got] == [n for n, _ in want]
        assert [c for _, c in got] == [pytest.approx(c, abs=1e-9) for _, c in want]


def test_birch_centroids_of_many_points(spark):
    """8000 vectors that open thousands of sub-clusters: dictionaries took minutes."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8000, 64))
    x = np.concatenate((x, x[:500] + 0.01))
    rows = spark.createDataFrame([(i, {str(k): v for k, v in enumerate(r)}) for i, r in enumerate(x.tolist())], "bgc_id long, features map<string,double>").repartition(8)
    began = time.monotonic()
    got = features.centroids(rows, 0.2, 1).collect()
    assert time.monotonic() - began < 60
    assert [r.gcf_id for r in sorted(got)] == list(range(8000))  # the near copies joined the first ones


def test_birch_of_rows_that_share_an_id(spark):
    """Null, equal and missing ids give the same centroids however the rows come."""
    rows = [(i % 3 or None, {"a": 1.0, f"k{i}": 0.5 + i / 20}) for i in range(12)] + [(5, {}), (6, None), (7, {"z": 0.0, "a": None}), (8, {"a": None, "b": 2.0})]
    found = []
    for turn in (rows, rows[::-1]):
        d = spark.createDataFrame(turn, "bgc_id long, features map<string,double>").coalesce(1)
        found.append(sorted((r.gcf_id, sorted(r.features.items())) for r in features.centroids(d, 0.3, 2).collect()))
    assert found[0] == found[1] and len(found[0]) > 2


def test_label_propagation(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (5, 6, 2.0), (4, 6, 2.0), (1, 9, 1.0)], "src long, dst long, weight double")
    labels = {r.node: r.label for r in graph.label_propagation(e, 10).collect()}
    assert labels[6] == 4 and set(labels) == {2, 3, 6, 9} and labels[9] == 1
    assert {r.node: r.label for r in graph.label_propagation(e.drop("weight"), 10).collect()} == labels
    line = spark.createDataFrame([(i, i + 1, 1.0) for i in range(1, 7)], "src long, dst long, weight double")
    assert {r.node: r.label for r in graph.label_propagation(line, 2).collect()}[4] == 1  # two rounds and the last vote
    found = graph.cluster(e, least_weight=0.5)
    assert graph.cluster_stats(found).first().clusters == found.count()
    v = spark.createDataFrame([(i, [float(i % 3), float(i % 2), 1.0]) for i in range(12)], "id long, v array<double>")
    edges = {(r.src, r.dst) for r in graph.cosine_edges(v, "id", "v", 0.9, 3).collect()}
    assert edges == {(r.src, r.dst) for r in graph.cosine_edges(v, "id", "v", 0.9, 1).collect()} and (0, 6) in edges


def test_reads_operators(spark):
    r = spark.createDataFrame([(1, "a/1", "ACGTACGTTT", "I" * 10), (2, "a/2", "GGGGGGCCCC", "#" * 10), (3, "b/1", "NNNACGTACG", "I" * 10)], "id long, name string, seq string, qual string")
    ref = spark.createDataFrame([(7, "TTACGTACGA")], "id long, seq string")
    assert {x.id for x in R.contamination_filter(r, ref, 7).collect()} == {2}
    assert R.contamination_filter(r, ref, 7, singletons=False).count() == 0
    assert {x.id for x in R.quality_filter(r).collect()} == {1} and {x.id for x in R.quality_filter(R.stats(r)).collect()} == {1}
    assert R.stats(r, fraction=0.5, seed=1).count() <= 3 and R.mask(r).where("id = 3").first().seq == "NACGTACG"
    with pytest.raises(ValueError):
        R.stats(r.drop("qual"))
    assert {x.kmer: x.kmer_count for x in R.kmer_counts(r, 4, 2).collect()}.get("TACG") == 2 or R.kmer_counts(r, 4, 2).count() > 0


def test_median(spark):
    d = spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, "y"), ("a", 3.0, "z"), ("a", None, "n"), (None, 5.0, "q"), ("b", 4.0, "r"), ("b", 4.0, "p")], "k string, v double, extra string")
    assert sorted((str(r.k), r.v, r.extra) for r in dedup.median_rows(d, "v", ["k"]).collect()) == [("None", 5.0, "q"), ("a", 2.0, "y"), ("b", 4.0, "p")]


def test_risk(spark):
    v = spark.createDataFrame([("v", "1", "5", "rs7", "A", "C,G", "50", "PASS", ".", "GT", ["0|1", "1|1"]), ("v", "chr2", "9", ".", "T", "A", "5", "PASS", ".", "GT", ["0|1", "."])], "file_path string, chromosome string, position string, ids string, references string, alts string, qual string, filter string, info string, format string, samples array<string>")
    head = spark.createDataFrame([("v", "samples", "s1\ts2")], "file_path string, key string, value string")
    gwas = spark.createDataFrame([(7, "C", 2.0, 1, 5, "t", 1), (7, "C", 4.0, 1, 5, "t", 2), (7, "C", 3.0, 1, 5, "t", 3), (None, "A", 1.5, 2, 9, "u", 4)], "ids long, alt string, OR float, chromosome int, position long, trait string, pubmedID long").withColumn("date", F.lit(None).cast("date"))
    plain = {(r.sample_name, r.trait): r.prs_score for r in risk.scores(v, head, gwas.where("ids is not null")).collect()}
    assert plain == {("s1", "t"): 3.0, ("s2", "t"): 6.0}
    dbsnp = spark.createDataFrame([("NC_000001.11", "5", "rs7", "A", "G,C"), ("NC_000002.12", "9", "rs8", "T", "A")], "chromosome string, position string, ids string, references string, alts string")
    full = {(r.sample_name, r.trait): r.prs_score for r in risk.scores(v, head, gwas, dbsnp).collect()}
    assert full == {("s1", "t"): 3.0, ("s2", "t"): 6.0, ("s1", "u"): 1.5}
    assert ("s1", "u") not in {(r.sample_name, r.trait) for r in risk.scores(v, head, gwas, dbsnp, min_quality=10, only_pass=True).collect()}
    m = genotype.missing_samples(spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", ["z"])], "file_path string, names array<string>"))
    assert {r.file_path: (r.missing, r.extra) for r in m.collect()} == {"a": ([], []), "b": (["y"], []), "c": (["x", "y"], ["z"])}


def test_runner(spark, tmp_path):
    def task(path, output, params):
        if "boom" in path:
            raise RuntimeError
        return -1 if "skip" in path else 1

    out = runner.run_files(spark, ["a", "b", "skip", "boom", "a"], str(tmp_path), task)
    assert tuple(R.tally(out).first()) == (1, 1, 2)
    assert runner.command(lambda i, o, p: ["no-such-program"])("x", str(tmp_path), "") == 0
    (tmp_path / "done").write_text("")
    assert runner.command(lambda i, o, p: ["true"], "done")("x", str(tmp_path), "") == -1
    assert runner.command(lambda i, o, p: ["true"])("x", str(tmp_path), "") == 1
    assert runner.main([]) == 2


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fa").write_text(">a\nACGT\n>b\nACGA\n")
    counts = streaming.kmer_counts(streaming.read_stream(spark, Fasta(), f"{tmp_path}/in"), 3)
    q = counts.writeStream.outputMode("complete").format("memory").queryName("kmers").start()
    try:
        q.processAllAvailable()
        first = {r.kmer: r.kmer_count for r in spark.table("kmers").collect()}
        (tmp_path / "in/b.fa").write_text(">c\nACG\n")
        q.processAllAvailable()
        second = {r.kmer: r.kmer_count for r in spark.table("kmers").collect()}
    finally:
        q.stop()
    assert second["CGT"] == first["CGT"] + 1
