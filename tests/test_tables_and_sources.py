import gzip

import pytest
from pyspark.sql import functions as F

from strandlake import files, table
from strandlake.sources import base, reads
from strandlake.sources.formats import Fasta, Gff3, Pairs, Vcf, VcfHeader
from strandlake.sources.genbank import GenBank, location


def meta(spark):
    return table.Metadata(spark.createDataFrame([("f", "a", "1"), ("f", "b", None), ("g", "c", "2"), ("g", "d", "3")], "file_path string, key string, value string"))


def test_validity_and_round_trip(spark, tmp_path):
    m = meta(spark)
    assert m.count_valids() == (3, 1) and m.valids().df.count() == 3 and m.invalids().df.count() == 1
    m.write(f"{tmp_path}/m")
    again = table.Metadata.read(spark, f"{tmp_path}/m")
    assert again.count_valids() == (3, 1) and again.id == m.id
    with pytest.raises(FileExistsError):
        m.write(f"{tmp_path}/m")
    changed = again.valids()
    changed.write(f"{tmp_path}/m", overwrite=True)
    assert table.Metadata.read(spark, f"{tmp_path}/m").count_valids() == (3, 0)
    with pytest.raises(TypeError):
        table.Features.read(spark, f"{tmp_path}/m")
    with pytest.raises(FileNotFoundError):
        table.Metadata.read(spark, f"{tmp_path}/none")


def test_idx_and_lineage(spark):
    m = meta(spark)
    with pytest.raises(ValueError):
        table.Metadata(m.df)
    kept, new = table.Metadata(m.df, keep_idx=True, override_idx=True), table.Metadata(m.df, override_idx=True, key=["file_path", "key"])
    assert kept.df.columns == ["idx", "file_path", "key", "value"] and new.df.select("idx").distinct().count() == 4
    kept.update_sources(m, m)
    assert kept.sources == [m.id]
    old = kept.id
    kept.df = kept.df.where("value is not null")
    assert kept.id != old
    with pytest.raises(AttributeError):
        table.Relation(spark.createDataFrame([("a", "b")], "idx_1 string, idx_2 string"))
    pairs = m.df.alias("a").join(m.df.alias("b"), F.expr("a.file_path = b.file_path")).select(F.expr("a.idx as idx_1"), F.expr("b.idx as idx_2"))
    assert table.Relation(pairs).count_valids() == (8, 0)


def test_sequence_validity(spark):
    ddl = "file_path string, seq_id string, desc string, sequence string, length long"
    n = [("f", "1", "", "ATGCn", 5), ("f", "2", "", "ATGC", 5), ("f", "3", "", "ATGX", 4), ("f", "4", "", "", 0), ("f", "5", "", None, None)]
    assert table.Nucleotides(spark.createDataFrame(n, ddl)).count_valids() == (1, 4)
    p = [("f", "1", "", "MKV*-", 5), ("f", "2", "", "MK", 3), ("f", "3", "", "M1", 2), ("f", "4", "", "", 0)]
    assert table.Proteins(spark.createDataFrame(p, ddl)).count_valids() == (1, 3)
    r = [(*n[0], [1] * 5), (*n[0], [1] * 4), (*n[2], [1] * 4)]
    assert table.Reads(spark.createDataFrame(r, ddl + ", quality array<tinyint>")).count_valids() == (1, 2)
    q = [(*r[0], "", 0, []), (*r[0], "AC", 3, [1, 1]), (*r[1], "A", 1, [1])]
    assert table.PairedReads(spark.createDataFrame(q, ddl + ", quality array<tinyint>, sequence_2 string, length_2 long, quality_2 array<tinyint>")).count_valids() == (1, 2)


def test_four_ways_to_load(spark, tmp_path):
    for f in "ab":
        (tmp_path / f"{f}.txt").write_text("".join(f"key_{i},value_{i}\n" for i in range(4)))
    paths = [f"{tmp_path}/a.txt", f"{tmp_path}/b.txt"]
    assert Pairs().load_small(spark, f"{tmp_path}/*.txt").df.count() == 8
    (tmp_path / "list").write_text("\n".join(paths))
    assert Pairs().load_listed(spark, f"{tmp_path}/list").df.count() == 8
    assert Pairs().load_big(spark, [paths[0], paths[0]]).df.count() == 8
    big = Pairs().load_big(spark, paths, f"{tmp_path}/keep")
    assert big.df.count() == 8 and Pairs().load_big(spark, paths, f"{tmp_path}/keep").df.count() == 8
    for other in ([paths[0]], [*paths, paths[0]]):
        with pytest.raises(FileExistsError):
            Pairs().load_big(spark, other, f"{tmp_path}/keep")
    with pytest.raises(FileNotFoundError):
        Pairs().load_big(spark, [f"{tmp_path}/none"])
    with pytest.raises(TypeError):
        Pairs().load_small(spark, paths)
    base.concatenate(spark, f"{tmp_path}/*.txt", f"{tmp_path}/cat")
    rows = Pairs().load_concatenated(spark, f"{tmp_path}/cat").df.collect()
    assert len(rows) == 8 and {r.file_path for r in rows} == set(paths) == {r.file_path for r in big.df.collect()}
    assert {(r.key, r.value) for r in rows} == {(f"key_{i}", f"value_{i}") for i in range(4)}


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(b">s1 first > one\nATG\nCAT\n>s2\r\nAC\r\nGT\r\n>s3\nACGT")
    rows = {r.seq_id: (r.desc, r.sequence, r.length) for r in Fasta().load_small(spark, f"{tmp_path}/x.fa").df.collect()}
    assert rows == {"s1": ("first > one", "ATGCAT", 6), "s2": ("", "ACGT", 4), "s3": ("", "ACGT", 4)}
    with pytest.raises(TypeError):
        Fasta("other")


def test_gff3(spark, tmp_path):
    (tmp_path / "g.gff").write_text("##gff-version 3\n# note\nc1\tsrc\tCDS\t5\t9\t.\t-\t0\tID=a;k=1,2;k=3;eq=a=b;x%20=y%2C;\nshort\tline\nc1\tsrc\tgene\t1\t3\t.\t.\t.\tID=b\n")
    rows = {r.type: r for r in Gff3(decode=True).load_small(spark, f"{tmp_path}/g.gff").df.collect()}
    q = {x.key: x["values"] for x in rows["CDS"].qualifiers}
    assert q == {"ID": ["a"], "k": ["1", "2", "3"], "eq": ["a=b"], "x%20": ["y,"], "gff3-source-column": ["src"]}
    place = rows["CDS"].location[0]
    assert (place.start, place.end, place.strand, rows["gene"].location[0].strand) == (5, 9, -1, 0)
    assert rows["CDS"].source_path == f"{tmp_path}/g.fna"
    assert Gff3(lambda p: p + ".x").load_small(spark, f"{tmp_path}/g.gff").df.first().source_path.endswith(".gff.x")


def test_vcf(spark, tmp_path):
    (tmp_path / "v.vcf").write_text("##fileformat=VCFv4\n##k=a=b\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t5\trs1\tA\tC,G\t.\tPASS\t.\tGT\t0|1\t.\n2\t6\t.\tA\tC\t9\tq\t.\n")
    head = {r.key: r.value for r in VcfHeader().load_small(spark, f"{tmp_path}/v.vcf").df.collect()}
    assert head == {"fileformat": "VCFv4", "k": "a=b", "samples": "s1\ts2"}
    rows = {r.chromosome: r for r in Vcf().load_small(spark, f"{tmp_path}/v.vcf").df.collect()}
    assert rows["1"].samples == ["0|1", "."] and rows["2"].samples == [] and rows["2"].format is None


GBK = '''LOCUS       TEST1                 48 bp    DNA     linear   BCT 01-JAN-2020
DEFINITION  A small
            record.
ACCESSION   TEST1
VERSION     TEST1.3
KEYWORDS    .
SOURCE      Some bug
  ORGANISM  Some bug
            Bacteria; Bugs.
COMMENT     Free words.
            ##Tool-START##
            Version      :: 1.2
            ##Tool-END##
FEATURES             Location/Qualifiers
     source          1..48
                     /organism="Some bug"
     CDS             complement(join(1..6,10..15))
                     /locus_tag="t1"
                     /note="two
                     lines, ""quoted"""
                     /translation="MK
                     V"
                     /transl_table=11
                     /pseudo
     gene            <7..>12
                     /gene="g"
     misc            join(1..3,complement(5..9))
ORIGIN
        1 atgcatgcat gcatgcatgc atgcatgcat gcatgcatgc atgcatgc
//
'''


def test_genbank(spark, tmp_path):
    (tmp_path / "t.gbk").write_text(GBK + GBK.replace("TEST1", "TEST2"))
    path = f"{tmp_path}/t.gbk"
    s = GenBank("sequence").load_small(spark, path)
    assert s.count_valids() == (2, 0) and {r.seq_id for r in s.df.collect()} == {"TEST1.3", "TEST2.3"} and s.df.first().desc == "A small record"
    f = GenBank("annotation").load_small(spark, path).df.where("seq_id = 'TEST1.3'").collect()
    boxes = {r.type: (r.location[0].start, r.location[0].end, r.location[0].strand) for r in f}
    assert boxes == {"source": (1, 48, 1), "CDS": (1, 15, -1), "gene": (7, 12, 1), "misc": (1, 9, 0)}
    q = {x.key: x["values"] for r in f if r.type == "CDS" for x in r.qualifiers}
    assert q == {"locus_tag": ["t1"], "note": ['two lines, "quoted"'], "translation": ["MKV"], "transl_table": ["11"], "pseudo": [""]}
    m = {r.key: r.value for r in GenBank("metadata").load_small(spark, path).df.where("file_path is not null").collect()}
    assert m["organism"] == "Some bug" and m["sequence_version"] == "3" and '"Version": "1.2"' in m["structured_comment"] and m["comment"] == "Free words."
    assert location("complement(join(1..2,<4..>9))") == [(1, 2, False, False, -1), (4, 9, True, True, -1)]
    with pytest.raises(TypeError):
        GenBank("other")
    (tmp_path / "bad.gbk").write_text(GBK.replace("<7..>12", "here") + GBK)
    assert GenBank("annotation").load_small(spark, f"{tmp_path}/bad.gbk", skip_malformed=True).df.count() >= 4
    with pytest.raises(Exception, match="Failed when parsing"):
        GenBank("annotation").load_small(spark, f"{tmp_path}/bad.gbk").df.collect()


def test_reads(spark, tmp_path):
    a = "@r1/1\nACGT\n+\nIIII\n@r2/1\nAC\n+\n@I\n"
    (tmp_path / "1.fq").write_text(a)
    with gzip.open(tmp_path / "2.fq.gz", "wt") as f:
        f.write("@r1/2\nGG\n+\nII\n")
    both = reads.load(spark, f"{tmp_path}/1.fq", f"{tmp_path}/2.fq.gz")
    assert [(r.name, r.seq, r.qual) for r in both.collect()] == [("@r1/1", "ACGT", "IIII"), ("@r1/2", "GG", "II"), ("@r2/1", "AC", "@I")]
    merged = {r.name: (r.seq, r.qual) for r in reads.load(spark, f"{tmp_path}/1.fq", f"{tmp_path}/2.fq.gz", join_pairs=True).collect()}
    assert merged == {"@r1": ("ACGTNGG", "IIIIBII"), "@r2": ("AC", "@I")}
    assert reads.load(spark, f"{tmp_path}/1.fq", max_reads=1).count() == 1
    reads.write_fastq_lines(both, f"{tmp_path}/lines")
    assert reads.fastq_lines(spark, f"{tmp_path}/lines").count() == 3
    (tmp_path / "x.sam").write_text("@HD\tVN:1\nq1\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII\n")
    assert [(r.name, r.seq) for r in reads.sam(spark, f"{tmp_path}/x.sam").collect()] == [("q1", "ACGT")]
    (tmp_path / "x.fa").write_text(">a\nAC\nGT\n>b\nTT\n")
    assert {(r.name, r.seq) for r in reads.load(spark, f"{tmp_path}/x.fa", format="fa").collect()} == {("a", "ACGT"), ("b", "TT")}
    reads.save(both, f"{tmp_path}/sorted", sort="name")
    assert reads.load(spark, f"{tmp_path}/sorted", format="pq").count() == 3
    (tmp_path / "v.tsv").write_text("id\tx\n1\t2.5\n")
    assert reads.vertices(spark, f"{tmp_path}/v.tsv", "TSV", "id long, x double").first().x == 2.5
    with pytest.raises(NotImplementedError):
        reads.vertices(spark, "p", "other")


def test_paths(spark, tmp_path):
    assert files.parse("s3://b/x.fa") == ("s3", "//b/x.fa") and files.parse("/a/b") == ("file", "/a/b")
    with pytest.raises(ValueError):
        files.parse("/a/b?c")
    files.write_text(spark, f"{tmp_path}/d/x", "héllo")
    assert files.read_text(spark, f"{tmp_path}/d/x") == "héllo" and files.is_directory(spark, f"{tmp_path}/d") and files.read_text(spark, f"{tmp_path}/no") is None
    files.copy(spark, f"{tmp_path}/d/x", f"{tmp_path}/d/y")
    assert len(files.glob(spark, f"{tmp_path}/d/*")) >= 2
    files.remove(spark, f"{tmp_path}/d")
    assert not files.exists(spark, f"{tmp_path}/d")
