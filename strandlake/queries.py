"""One query for each operator on the driver's tables, and the same in SQL.

The tables stand in for domain data: document texts reduced to A, C, G, T are sequences, conversations read pairs, events
located features, lineitem and orders variants and measures, embeddings feature vectors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, runner
from .functions import loc, variant, vec
from .functions import register
from .functions import seq as S
from .operators import annotation, dedup, features, genotype, graph
from .operators import reads as R
from .plans import clusters as P
from .plans import risk
from .plans.clusters import split_subfamily
from .sources import base as B
from .sources import reads as SR
from .sources.formats import Fasta, Gff3, Pairs, Vcf, VcfHeader
from .sources.genbank import GenBank
from .table import Cds, Features, Metadata, Nucleotides, PairedReads, Proteins, Reads, Relation

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f"q_{f.__name__}"] = f
        if sql:
            ORACLES[f"q_{f.__name__}"] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def checkpoints(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:  # a folder that executors share, on the default file system
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def acgt(c):
    return F.regexp_replace(F.translate(c, "acgt", "ACGT"), "[^ACGT]", "")


ACGT = "regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g')"
REVCOMP = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def seqs(spark, sf):
    return t(spark, sf, "documents").select(F.col("doc_id").alias("id"), acgt(F.col("text")).alias("seq"))


SEQS = f"s AS (SELECT doc_id AS id, {ACGT} AS seq FROM documents)"


# --- scalar functions ------------------------------------------------------------------------------------------------
@query("SELECT doc_id, round(len(regexp_extract_all(text, '[GCgc]')) * 100.0 / nullif(len(regexp_extract_all(text, '[ACGTacgt]')), 0), 6) AS gc FROM documents")
def gc_percent(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.round(S.gc_percent(F.col("text")), 6).alias("gc"))


@query("SELECT doc_id, len(regexp_extract_all(text, 'N'))::INT AS n, regexp_replace(text, '[^AGCT]+', 'N', 'g') AS masked FROM documents")
def n_count_and_mask(spark, sf):
    return t(spark, sf, "documents").select("doc_id", S.n_count(F.col("text")).alias("n"), S.mask_n(F.col("text")).alias("masked"))


@query("SELECT doc_id, round(list_sum(list_transform(string_split(q, ''), lambda c: ord(c))) / nullif(length(q), 0) - 33, 6) AS quality FROM (SELECT doc_id, regexp_replace(text, '[^!-~]', '', 'g') AS q FROM documents)")
def mean_quality(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.round(S.mean_quality(F.regexp_replace("text", "[^!-~]", "")), 6).alias("quality"))


@query(f"WITH {SEQS} SELECT id, {REVCOMP.format('seq')} AS rc FROM s")
def reverse_complement(spark, sf):
    return seqs(spark, sf).select("id", S.reverse_complement(F.col("seq")).alias("rc"))


@query(f"WITH {SEQS}, p AS (SELECT id, seq, 1 + id % 7 AS a, 40 + id % 50 AS b, CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END AS strand FROM s), c AS (SELECT id, strand, substring(seq, a, b - a + 1) AS x FROM p) SELECT id, CASE WHEN strand < 0 THEN {REVCOMP.format('x')} ELSE x END AS part FROM c")
def slice_strand(spark, sf):
    i = F.col("id")
    return seqs(spark, sf).select("id", S.slice_strand(F.col("seq"), 1 + i % 7, 40 + i % 50, F.when(i % 2 == 0, 1).otherwise(-1)).alias("part"))


@query(
    f"WITH {SEQS}, c(tab, code) AS (VALUES (1, '{S.CODES[1]}'), (2, '{S.CODES[2]}'), (11, '{S.CODES[11]}')), p AS (SELECT id, seq, (CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 11 ELSE 99 END) AS tab FROM s) "
    "SELECT id, rtrim(array_to_string(list_transform(range(0, length(seq) // 3), lambda i: substring(code, 16 * (instr('TCAG', seq[3 * i + 1]) - 1) + 4 * (instr('TCAG', seq[3 * i + 2]) - 1) + instr('TCAG', seq[3 * i + 3]), 1)), ''), '*') AS aa FROM p LEFT JOIN c USING (tab) WHERE tab <> 99 UNION ALL SELECT id, NULL FROM p WHERE tab = 99"
)
def translate(spark, sf):
    i = F.col("id") % 4
    table = F.when(i == 0, 1).when(i == 1, 2).when(i == 2, 11).otherwise(99)
    return seqs(spark, sf).select("id", S.translate(F.col("seq"), table).alias("aa"))


@query("SELECT event_id, CASE WHEN (event_id % 30) BETWEEN 1 AND 25 THEN (event_id % 30)::INT WHEN event_id % 30 = 26 THEN 23 WHEN event_id % 30 = 27 THEN 25 END AS chromosome, event_id * 3 AS rs FROM events")
def chromosome_and_rs_number(spark, sf):
    m = F.col("event_id") % 30
    name = F.when(m == 26, "chrX").when(m == 27, "MT").when(m % 3 == 0, F.concat(F.lit("NC_0000"), F.lpad(m.cast("string"), 2, "0"), F.lit(".11"))).when(m % 3 == 1, F.concat(F.lit("chr"), m.cast("string"))).otherwise(m.cast("string"))
    rs = F.when(m % 2 == 0, F.concat(F.lit("rs"), (F.col("event_id") * 3).cast("string"))).otherwise((F.col("event_id") * 3).cast("string"))
    return t(spark, sf, "events").select("event_id", variant.chromosome_number(name).alias("chromosome"), variant.rs_number(rs).alias("rs"))


@query("SELECT l_orderkey, l_linenumber, [l_linenumber % 3, coalesce(nullif(CAST(l_quantity AS BIGINT) % 4, 3), 0)::INT] AS alleles FROM lineitem")
def genotype_parse(spark, sf):
    b = F.col("l_quantity").cast("long") % 4
    gt = F.concat_ws("|", (F.col("l_linenumber") % 3).cast("string"), F.when(b == 3, ".").otherwise(b.cast("string")))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", variant.genotype_alleles(F.concat(gt, F.lit(":12:PASS"))).alias("alleles"))


@query("SELECT p_partkey, p_brand AS core, p_size AS number FROM part")
def subfamily_name(spark, sf):
    core, number = split_subfamily(F.concat("p_brand", F.lit(".aligned_c"), F.col("p_size").cast("string")))
    return t(spark, sf, "part").select("p_partkey", core.alias("core"), number.alias("number"))


@query(
    "WITH q AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events) "
    "SELECT event_id, k AS first, CASE WHEN k IS NULL THEN NULL ELSE TRY_CAST(k AS TINYINT) END AS number, event_type AS kind, 2 AS others FROM q"
)
def qualifier_lookup(spark, sf):
    k = F.get_json_object("props", "$.k")
    q = F.array(F.struct(F.lit("k").alias("key"), F.array(k, F.lit("x")).alias("values")), F.struct(F.lit("type").alias("key"), F.array("event_type").alias("values")), F.struct(F.lit("k").alias("key"), F.array(F.lit("later")).alias("values")))
    d = t(spark, sf, "events").select("event_id", q.alias("q"))
    return d.select("event_id", loc.qualifier(F.col("q"), "k").alias("first"), loc.numeric_qualifier(F.col("q"), "k").alias("number"), loc.qualifier(F.col("q"), "type").alias("kind"), F.size(loc.other_qualifiers(F.col("q"), "type")).alias("others"))


@query(
    "SELECT l_orderkey, min(l_partkey) AS \"start\", max(l_partkey + CAST(l_quantity AS BIGINT)) AS \"end\", (CASE WHEN count(DISTINCT s) = 1 THEN min(s) ELSE 0 END)::TINYINT AS strand "
    "FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS s FROM lineitem) GROUP BY l_orderkey"
)
def location_envelope(spark, sf):
    s = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0).cast("tinyint")
    part = F.struct(F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"), s.alias("strand"))
    d = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(part).alias("location"))
    return d.select("l_orderkey", loc.envelope(F.col("location")).alias("e")).select("l_orderkey", "e.start", "e.end", "e.strand")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: (x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) ** 2)), 6) AS unit FROM embeddings")
def l2_normalize(spark, sf):
    m = F.map_from_arrays(F.transform("embedding", lambda x, i: i.cast("string")), F.transform("embedding", lambda x: x.cast("double")))
    d = t(spark, sf, "embeddings").select("vec_id", m.alias("m"))
    square = lambda c: F.aggregate(F.map_values(c), F.lit(0.0), lambda a, x: a + x * x)
    return d.select("vec_id", F.round(F.sqrt(square(F.col("m"))), 6).alias("norm"), F.round(square(vec.l2_normalize(F.col("m"))), 6).alias("unit"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(1 - list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclid FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_similarity(spark, sf):
    e = t(spark, sf, "embeddings")
    d = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return d.select("vec_id", F.round(vec.similarity(F.col("a"), F.col("b"), "cosine"), 6).alias("cosine"), F.round(vec.similarity(F.col("a"), F.col("b"), "euclidean"), 6).alias("euclid"))


@query("SELECT doc_id, round(len(regexp_extract_all(text, '[GCgc]')) * 100.0 / nullif(len(regexp_extract_all(text, '[ACGTacgt]')), 0), 6) AS gc, len(regexp_extract_all(text, 'N'))::INT AS n FROM documents")
def sql_functions(spark, sf):
    register(spark)
    return t(spark, sf, "documents").selectExpr("doc_id", "round(gc_percent(text), 6) AS gc", "n_count(text) AS n")


# --- validity --------------------------------------------------------------------------------------------------------
def _checked(spark, sf):
    i = F.col("doc_id")
    s = F.when(i % 3 == 0, acgt(F.col("text"))).when(i % 3 == 1, F.col("text")).otherwise(F.lit(""))
    return t(spark, sf, "documents").select("doc_id", s.alias("sequence")).withColumn("length", (F.length("sequence") + F.when(i % 5 == 0, 1).otherwise(0)).cast("long"))


CHECKED = f"c AS (SELECT doc_id, seq AS sequence, (length(seq) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS length FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {ACGT} WHEN 1 THEN text ELSE '' END AS seq FROM documents)), v AS (SELECT *, regexp_full_match(sequence, '[ATGCNatgcn]+') AND length(sequence) = length AND length > 0 AS ok FROM c)"


@query(f"WITH {CHECKED} SELECT count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid FROM v")
def count_valids(spark, sf):
    ok = Nucleotides._valid()
    return _checked(spark, sf).agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@query(f"WITH {CHECKED} SELECT doc_id, length FROM v WHERE ok")
def filter_valids(spark, sf):
    return _checked(spark, sf).where(Nucleotides._valid()).select("doc_id", "length")


@query(f"WITH {CHECKED} SELECT doc_id, length FROM v WHERE NOT ok")
def filter_invalids(spark, sf):
    return _checked(spark, sf).where(~Nucleotides._valid()).select("doc_id", "length")


@query("SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, '[A-Za-z*-]+')")
def protein_alphabet(spark, sf):
    d = t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("sequence"), F.length("p_brand").cast("long").alias("length"))
    return d.where(Proteins._valid()).select("p_partkey")


# --- reads -----------------------------------------------------------------------------------------------------------
@query(f"WITH {SEQS}, k AS (SELECT DISTINCT id, greatest(x, {REVCOMP.format('x')}) AS kmer FROM (SELECT id, substring(seq, i, 11) AS x FROM (SELECT id, seq, unnest(range(1, length(seq) - 9)) AS i FROM s WHERE length(seq) >= 11))) SELECT kmer, count(*) AS kmer_count FROM k GROUP BY kmer HAVING count(*) >= 2")
def kmer_count(spark, sf):
    return R.kmer_counts(seqs(spark, sf), 11, 2)


@query()
def minimizer_count(spark, sf):
    return R.kmer_counts(seqs(spark, sf), 15, 2, windows=16)


SHARED = f"WITH {SEQS}, r AS (SELECT item_id AS id, {ACGT} AS seq FROM benchmark), k AS (SELECT 0 AS ref, id, seq FROM s UNION ALL SELECT 1, id, seq FROM r), m AS (SELECT DISTINCT ref, id, greatest(x, {REVCOMP.format('x')}) AS kmer FROM (SELECT ref, id, substring(seq, i, 21) AS x FROM (SELECT ref, id, seq, unnest(range(1, length(seq) - 19)) AS i FROM k WHERE length(seq) >= 21))), hit AS (SELECT DISTINCT a.id FROM m a JOIN m b ON a.kmer = b.kmer WHERE a.ref = 0 AND b.ref = 1) "


def _reference(spark, sf):
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("id"), acgt(F.col("text")).alias("seq"))


@query(SHARED + "SELECT id, length(seq)::INT AS n FROM s WHERE id NOT IN (SELECT id FROM hit)")
def contamination_anti(spark, sf):
    return R.contamination_filter(seqs(spark, sf), _reference(spark, sf), 21).select("id", F.length("seq").alias("n"))


@query(SHARED + "SELECT id FROM hit")
def contamination_semi(spark, sf):
    return R.contaminated(seqs(spark, sf), _reference(spark, sf), 21)


@query()
def contamination_minimizer(spark, sf):
    return R.contamination_filter(seqs(spark, sf), _reference(spark, sf), 31, minimizer=True).select("id")


def _pairs(spark, sf):
    return t(spark, sf, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("name"), F.col("text").alias("seq"), F.col("role").alias("qual"))


@query("SELECT conv_id::VARCHAR AS name, string_agg(text, 'N' ORDER BY lpad(turn::VARCHAR, 4, '0')) AS seq, string_agg(role, 'B' ORDER BY lpad(turn::VARCHAR, 4, '0')) AS qual FROM conversations GROUP BY conv_id")
def pair_merge(spark, sf):
    return SR.merge_pairs(_pairs(spark, sf)).select("name", "seq", "qual")


@query("SELECT concat(conv_id, '/', lpad(turn::VARCHAR, 4, '0')) AS name FROM conversations WHERE turn < 2 AND role = 'user' OR conv_id % 3 = 0 QUALIFY count(*) OVER (PARTITION BY conv_id) > 1")
def pair_survival(spark, sf):
    c = t(spark, sf, "conversations").where("turn < 2 AND role = 'user' OR conv_id % 3 = 0")
    d = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("name"))
    return R.surviving_pairs(d)


STATS = "r AS (SELECT doc_id AS id, text AS seq, regexp_replace(text, '[^!-~]', '', 'g') AS q FROM documents), st AS (SELECT id, round(len(regexp_extract_all(seq, '[GCgc]')) * 100.0 / nullif(len(regexp_extract_all(seq, '[ACGTacgt]')), 0), 6) AS gc, round(list_sum(list_transform(string_split(q, ''), lambda c: ord(c))) / nullif(length(q), 0) - 33, 6) AS mean_quality, length(seq)::INT AS length, len(regexp_extract_all(seq, 'N'))::INT AS N_count FROM r)"


def _quality(spark, sf):
    return t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq"), F.regexp_replace("text", "[^!-~]", "").alias("qual"))


@query(f"WITH {STATS} SELECT * FROM st")
def read_stats(spark, sf):
    d = R.stats(_quality(spark, sf))
    return d.withColumn("gc", F.round("gc", 6)).withColumn("mean_quality", F.round("mean_quality", 6))


@query(f"WITH {STATS} SELECT id FROM st WHERE N_count <= 2 AND mean_quality >= 66")
def quality_filter(spark, sf):
    return R.quality_filter(_quality(spark, sf), 2, 66).select("id")


@query()
def sampled_stats(spark, sf):
    return R.stats(_quality(spark, sf), fraction=0.1)


@query("SELECT (CASE WHEN l_extendedprice < 0 THEN 0 WHEN l_extendedprice >= 100000 THEN 21 ELSE floor(l_extendedprice / 5000) + 1 END)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, sf):
    return R.histogram(t(spark, sf, "lineitem"), "l_extendedprice", 20, 0.0, 100000.0)


@query("SELECT count(*) FILTER (s = -1) AS skipped, count(*) FILTER (s = 0) AS failed, count(*) FILTER (s = 1) AS succeeded FROM (SELECT event_id % 3 - 1 AS s FROM events)")
def batch_tally(spark, sf):
    return R.tally(t(spark, sf, "events").select((F.col("event_id") % 3 - 1).alias("status")))


# --- joins and annotation --------------------------------------------------------------------------------------------
def _spans(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_timestamp("ts").alias("start"))
    long, short = e.where("event_type = 'error'"), e.where("event_type <> 'error'")
    return long.select("event_id", "user_id", "start", (F.col("start") + 40000).alias("end")), short.select("event_id", "user_id", "start", (F.col("start") + 60).alias("end"))


CONTAINED = "WITH e AS (SELECT event_id, user_id, event_type, cast(floor(epoch(ts)) AS BIGINT) AS s FROM events) SELECT a.event_id AS \"outer\", b.event_id AS \"inner\" FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type <> 'error' AND a.s <= b.s AND a.s + 40000 >= b.s + 60"


@query(CONTAINED)
def containment_join(spark, sf):
    return annotation.contained(*_spans(spark, sf), ["user_id"], "start", "end").select(F.col("o_event_id").alias("outer"), F.col("i_event_id").alias("inner"))


@query(CONTAINED)
def containment_binned(spark, sf):
    return annotation.contained(*_spans(spark, sf), ["user_id"], "start", "end", bin_size=20000).select(F.col("o_event_id").alias("outer"), F.col("i_event_id").alias("inner"))


def _genes(spark, sf):
    """Three coding sequences on each document's contig, as raw features."""
    contigs = t(spark, sf, "documents").select(F.lit("f").alias("file_path"), F.col("doc_id").cast("string").alias("seq_id"), acgt(F.col("text")).alias("sequence")).withColumn("length", F.length("sequence").cast("long"))
    q = lambda k, v: F.struct(F.lit(k).alias("key"), F.array(v).alias("values"))
    n = t(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"))
    seg = F.struct((1 + F.col("j") * 30).cast("long").alias("start"), (30 + F.col("j") * 30).cast("long").alias("end"), F.lit(False).alias("start_partial"), F.lit(False).alias("end_partial"), F.when(F.col("j") == 1, -1).otherwise(1).cast("tinyint").alias("strand"))
    tag = F.concat_ws("_", F.col("doc_id").cast("string"), F.col("j").cast("string"))
    kind = F.when(F.col("j") < 2, "CDS").otherwise("region")
    f = n.select(F.lit("f").alias("file_path"), F.lit("f").alias("source_path"), F.col("doc_id").cast("string").alias("seq_id"), kind.alias("type"), F.array(seg).alias("location"), F.array(q("locus_tag", tag), q("transl_table", F.lit("11")), q("product", F.lit("NRPS")), q("contig_edge", F.when(F.col("doc_id") % 2 == 0, "True").otherwise("False"))).alias("qualifiers"))
    return f, contigs


AA = "rtrim(array_to_string(list_transform(range(0, length(x) // 3), lambda i: substring('{0}', 16 * (instr('TCAG', x[3 * i + 1]) - 1) + 4 * (instr('TCAG', x[3 * i + 2]) - 1) + instr('TCAG', x[3 * i + 3]), 1)), ''), '*')".format(S.CODES[11])


@query(f"WITH {SEQS}, j AS (SELECT id, concat(id, '_', j) AS locus_tag, CASE WHEN j = 1 THEN {REVCOMP.format('substring(seq, 31, 30)')} ELSE substring(seq, 1, 30) END AS x FROM s, (VALUES (0), (1)) v(j)) SELECT locus_tag, {AA} AS aa FROM j")
def cds_translation(spark, sf):
    f, contigs = _genes(spark, sf)
    return annotation.translate_cds(annotation.cds_from_features(f), contigs).select("locus_tag", F.col("aa_sequence").alias("aa"))


@query(f"WITH {SEQS} SELECT id::VARCHAR AS seq_id, 'NRPS' AS class, substring(seq, 61, 30) AS nt_seq, length(seq) <= 90 OR false AS edge FROM s")
def cluster_fill(spark, sf):
    f, contigs = _genes(spark, sf)
    d = annotation.fill_clusters(annotation.clusters_from_features(f), contigs, check_edges=True)
    return d.select("seq_id", F.get("classes", F.lit(0)).alias("class"), "nt_seq", F.col("on_contig_edge").alias("edge"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_by_source(spark, sf):
    return t(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# --- de-duplication, order ---------------------------------------------------------------------------------------------
@query("WITH m AS (SELECT l_suppkey, l_returnflag, quantile_disc(l_quantity, 0.5) AS med FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_returnflag, l_quantity, l_orderkey, l_linenumber FROM lineitem JOIN m USING (l_suppkey, l_returnflag) WHERE l_quantity = med QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber) = 1")
def median_dedup(spark, sf):
    d = t(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", "l_orderkey", "l_linenumber")
    return dedup.median_rows(d, "l_quantity", ["l_suppkey", "l_returnflag"], ties=["l_orderkey", "l_linenumber"])


@query("SELECT c_nationkey, c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) = 1")
def distinct_subset(spark, sf):
    return dedup.keep_first(t(spark, sf, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), ["c_nationkey", "c_mktsegment"], [F.col("c_custkey")])


@query("SELECT concat(conv_id, '/', lpad(turn::VARCHAR, 4, '0')) AS name, text AS seq FROM conversations ORDER BY name LIMIT 100")
def first_reads(spark, sf):
    return _pairs(spark, sf).select("name", "seq").orderBy("name").limit(100)


@query("SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS low, max(l_quantity) AS high, quantile_disc(l_quantity, 0.25) AS q1, quantile_disc(l_quantity, 0.75) AS q3 FROM lineitem")
def summary(spark, sf):
    c = F.col("l_quantity")
    return t(spark, sf, "lineitem").agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("sd"), F.min(c).alias("low"), F.max(c).alias("high"), F.percentile_approx(c, 0.25).alias("q1"), F.percentile_approx(c, 0.75).alias("q3"))


# --- genotypes -------------------------------------------------------------------------------------------------------
def _variants(spark, sf):
    o = t(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("ids"), F.col("o_orderstatus").alias("references"), F.regexp_replace("o_orderpriority", "[- ]+", ",").alias("alts"))


VARIANTS = "v AS (SELECT o_orderkey AS ids, string_split(concat(o_orderstatus, ',', regexp_replace(o_orderpriority, '[- ]+', ',', 'g')), ',') AS al FROM orders)"


@query(f"WITH {VARIANTS} SELECT ids, unnest(range(0, len(al)))::INT AS code, unnest(al) AS allele FROM v")
def allele_explode(spark, sf):
    return genotype.allele_rows(_variants(spark, sf))


@query(f"WITH {VARIANTS}, a AS (SELECT ids, unnest(range(0, len(al)))::INT AS code1k, unnest(al) AS allele FROM v), b AS (SELECT ids, unnest(range(0, len(al)))::INT AS code, unnest(list_reverse(al)) AS allele FROM v) SELECT DISTINCT ids, code1k, code FROM a JOIN b USING (ids, allele)")
def allele_encoding(spark, sf):
    v = _variants(spark, sf)
    al = F.reverse(variant.alleles(F.col("references"), F.col("alts")))
    other = v.select("ids", F.get(al, F.lit(0)).alias("references"), F.array_join(F.slice(al, F.lit(2), F.size(al)), ",").alias("alts"))
    return genotype.encode_alleles(v, other)


def _genotypes(spark, sf):
    gt = F.concat_ws("|", (F.col("l_linenumber") % 3).cast("string"), (F.col("l_quantity").cast("long") % 2).cast("string"))
    return t(spark, sf, "lineitem").select(F.col("l_partkey").alias("ids"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("sample_name"), gt.alias("gt"))


DOSE = "g AS (SELECT l_partkey AS \"rsID\", concat('s', l_suppkey) AS sample_name, unnest([l_linenumber % 3, CAST(l_quantity AS BIGINT) % 2])::INT AS code FROM lineitem), dose AS (SELECT sample_name, \"rsID\", code, count(*)::DOUBLE AS dose FROM g GROUP BY ALL)"


@query(f"WITH {DOSE} SELECT * FROM dose")
def dose(spark, sf):
    return genotype.doses(_genotypes(spark, sf))


@query(f"WITH {DOSE} SELECT sample_name, p_brand AS trait, p_size::BIGINT AS \"pubmedID\", round(sum(dose * (p_retailprice / 1000)), 4) AS prs_score FROM dose JOIN part ON \"rsID\" = p_partkey AND code = p_size % 3 GROUP BY ALL")
def risk_score(spark, sf):
    c = t(spark, sf, "part").select(F.col("p_partkey").alias("ids"), (F.col("p_size") % 3).alias("code"), (F.col("p_retailprice") / 1000).alias("OR"), F.col("p_brand").alias("trait"), F.col("p_size").cast("long").alias("pubmedID"), F.lit(None).cast("date").alias("date"))
    return genotype.risk_scores(genotype.doses(_genotypes(spark, sf)), c).select("sample_name", "trait", "pubmedID", F.round("prs_score", 4).alias("prs_score"))


@query("WITH r AS (SELECT c_nationkey AS ids, c_mktsegment AS sample_name, max(c_custkey % 3)::VARCHAR AS gt FROM customer WHERE c_acctbal > 9000 GROUP BY ALL) SELECT ids, sample_name, coalesce(gt, '0') AS gt FROM (SELECT DISTINCT ids FROM r) CROSS JOIN (SELECT DISTINCT sample_name FROM r) LEFT JOIN r USING (ids, sample_name)")
def fill_samples(spark, sf):
    r = t(spark, sf, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("ids"), F.col("c_mktsegment").alias("sample_name")).agg(F.max(F.col("c_custkey") % 3).cast("string").alias("gt"))
    return genotype.fill_samples(r)


@query(
    "WITH n AS (SELECT l_suppkey AS k, list(DISTINCT l_linenumber::VARCHAR) AS names FROM lineitem WHERE l_discount > l_tax AND l_quantity > 48 GROUP BY 1), p AS (SELECT concat('f', lpad(k::VARCHAR, 8, '0')) AS file_path, names FROM n), top AS (SELECT arg_max(names, (len(names), file_path)) AS t FROM p) "
    "SELECT file_path, list_sort(list_filter(t, lambda x: NOT list_contains(names, x))) AS missing, list_sort(list_filter(names, lambda x: NOT list_contains(t, x))) AS extra FROM p, top"
)
def missing_samples(spark, sf):
    d = t(spark, sf, "lineitem").where("l_discount > l_tax and l_quantity > 48").groupBy("l_suppkey").agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("names"))
    return genotype.missing_samples(d.select(F.concat(F.lit("f"), F.lpad(F.col("l_suppkey").cast("string"), 8, "0")).alias("file_path"), "names"))


def _places(spark, sf):
    rows = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("ids"), (F.col("o_custkey") % 25 + 1).cast("string").alias("chromosome"), (F.col("o_orderkey") % 500).cast("string").alias("position"))
    ref = t(spark, sf, "part").select((F.col("p_size") % 25 + 1).alias("chromosome"), (F.col("p_partkey") % 500).alias("position"), (F.col("p_partkey") + 1000000).alias("ids"))
    return rows, ref


PLACES = "ref AS (SELECT (p_size % 25 + 1)::INT AS c, p_partkey % 500 AS p, min(p_partkey + 1000000) AS ids FROM part GROUP BY 1, 2), o AS (SELECT *, (o_custkey % 25 + 1)::INT AS c, o_orderkey % 500 AS p FROM orders)"


@query(f"WITH {PLACES} SELECT o_orderkey, coalesce(ref.ids, o_orderkey) AS ids FROM o LEFT JOIN ref USING (c, p)")
def rs_update(spark, sf):
    return genotype.update_ids(*_places(spark, sf)).select("o_orderkey", "ids")


@query(f"WITH {PLACES} SELECT o_orderkey, ref.ids FROM o JOIN ref USING (c, p)")
def rs_update_matched(spark, sf):
    return genotype.update_ids(*_places(spark, sf), keep=False).select("o_orderkey", "ids")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus = 'F'")
def variant_filter(spark, sf):
    q = F.when(F.col("o_orderkey") % 10 == 0, F.lit(".")).otherwise(F.lit("50"))
    d = t(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("qual"), F.when(F.col("o_orderstatus") == "F", "PASS").otherwise(q).alias("filter"))
    return genotype.passing(d, 100000, True).select("o_orderkey")


@query("SELECT p_partkey AS ids, p_brand AS alt, (p_size / 10)::FLOAT AS \"OR\", (p_size % 25 + 1)::INT AS chromosome, p_partkey * 7 AS position, p_type AS trait, DATE '2020-01-01' AS date, p_size::BIGINT AS \"pubmedID\" FROM part WHERE p_size % 4 <> 0")
def association_catalog(spark, sf):
    odd = F.col("p_partkey") % 2 == 1
    chrom, pos = (F.col("p_size") % 25 + 1).cast("string"), (F.col("p_partkey") * 7).cast("string")
    number = (F.col("p_size") % 25 + 1)
    named = F.when(number == 23, "X").when(number == 24, "Y").when(number == 25, "M").otherwise(chrom)
    d = t(spark, sf, "part").select(
        F.concat(F.lit("chr"), named, F.lit(":"), pos).alias("SNPs"),
        F.when(odd, named).alias("CHR_ID"),
        F.when(odd, pos).alias("CHR_POS"),
        F.col("p_partkey").cast("string").alias("SNP_ID_CURRENT"),
        F.col("p_brand").alias("rallele"),
        F.when(F.col("p_size") % 4 == 0, "NR").otherwise((F.col("p_size") / 10).cast("string")).alias("OR or BETA"),
        F.col("p_type").alias("DISEASE/TRAIT"),
        F.lit("2020-01-01").alias("DATE ADDED TO CATALOG"),
        F.col("p_size").cast("string").alias("PUBMEDID"),
    )
    return SR.catalog(d)


# --- feature vectors, graphs -----------------------------------------------------------------------------------------
@query("WITH r AS (SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS r FROM lineitem) SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, (255 - floor(255.0 / 3 * (r - 1)))::DOUBLE AS value FROM r WHERE r <= 3")
def topk_weights(spark, sf):
    d = t(spark, sf, "lineitem").withColumn("bitscore", F.col("l_extendedprice")).withColumn("member", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return features.ranked_features(d, ["l_suppkey"], "l_returnflag", "member", 3).select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "value")


@query("WITH u AS (SELECT user_id AS bgc_id, event_type AS key, max(value) AS value FROM (SELECT user_id, event_type, value FROM events UNION ALL SELECT user_id, 'any', 255 FROM events UNION ALL SELECT user_id, event_type, event_id % 100 FROM events) GROUP BY ALL) SELECT bgc_id, count(*)::INT AS size, string_agg(key, ',' ORDER BY key) AS keys, round(sum(value), 6) AS total FROM u GROUP BY bgc_id")
def map_max_merge(spark, sf):
    e = t(spark, sf, "events").withColumnRenamed("user_id", "bgc_id")
    a = e.select("bgc_id", F.col("event_type").alias("key"), "value")
    b = e.select("bgc_id", F.lit("any").alias("key"), F.lit(255.0).alias("value"))
    c = e.select("bgc_id", F.col("event_type").alias("key"), (F.col("event_id") % 100).cast("double").alias("value"))
    d = features.vectors(a, b, c)
    return d.select("bgc_id", F.size("features").alias("size"), F.array_join(F.array_sort(F.map_keys("features")), ",").alias("keys"), F.round(F.aggregate(F.map_values("features"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT DISTINCT o_custkey AS bgc_id, l_returnflag AS key, 255.0::DOUBLE AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= CASE l_returnflag WHEN 'A' THEN 10 WHEN 'N' THEN 20 ELSE 30 END")
def domain_features(spark, sf):
    hits = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cds_id"), F.col("l_returnflag").alias("hmm_acc"), F.col("l_quantity").alias("bitscore"))
    cuts = spark.createDataFrame([("A", 10.0), ("N", 20.0), ("R", 30.0)], "hmm_acc string, cutoff double")
    members = t(spark, sf, "orders").select(F.col("o_orderkey").alias("cds_id"), F.col("o_custkey").alias("bgc_id"))
    return features.domain_features(features.cutoff_hits(hits, cuts), members)


def _vectors(spark, sf):
    e = t(spark, sf, "embeddings")
    m = F.map_from_arrays(F.transform("embedding", lambda x, i: i.cast("string")), F.transform("embedding", lambda x: x.cast("double")))
    v = e.select(F.col("vec_id").alias("bgc_id"), "label", m.alias("features"))
    c = v.select("label", F.explode("features").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x"))
    c = c.groupBy(F.col("label").cast("long").alias("gcf_id")).agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("features"))
    return v.select("bgc_id", "features"), c


@query(
    "WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings), "
    "c AS (SELECT label::BIGINT AS gcf_id, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL) GROUP BY label) "
    "SELECT vec_id AS bgc_id, gcf_id, round(list_distance(v, c), 6) AS dist FROM v, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(v, c), 9), gcf_id) = 1"
)
def nearest_neighbour(spark, sf):
    return features.nearest(*_vectors(spark, sf)).withColumn("dist", F.round("dist", 6))


@query()
def birch_centroids(spark, sf):
    d = features.centroids(_vectors(spark, sf)[0], 0.9, 4)
    return d.select("gcf_id", F.size("features").alias("size"))


EDGES = "e AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS weight FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4)"


def _edges(spark, sf):
    return graph.cosine_edges(t(spark, sf, "embeddings"), "vec_id", "embedding", 0.4).withColumn("weight", F.round("weight", 6))


@query(f"WITH {EDGES} SELECT * FROM e")
def cosine_edges(spark, sf):
    return _edges(spark, sf)


STEP = "SELECT coalesce(l.node, w.dst) AS node, coalesce(w.cid, l.label) AS label FROM {0} l FULL JOIN (SELECT dst, cid FROM (SELECT dst, coalesce(label, src) AS cid, round(sum(weight), 6) AS vote FROM e LEFT JOIN {0} ON src = node GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY vote DESC, cid) = 1) w ON l.node = w.dst"


@query(f"WITH {EDGES}, l0 AS (SELECT DISTINCT src AS node, src AS label FROM e), l1 AS ({STEP.format('l0')}) SELECT * FROM l1")
def lpa_step(spark, sf):
    e = _edges(spark, sf)
    return graph.lpa_step(e, e.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))


def rounds(n: int) -> str:
    """``n`` rounds and the last vote, unrolled; further rounds change nothing once labels are stable."""
    steps = ", ".join(f"l{i} AS MATERIALIZED ({STEP.format(f'l{i - 1}')})" for i in range(1, n + 2))
    return f"WITH {EDGES.replace('e AS (', 'e AS MATERIALIZED (', 1)}, l0 AS (SELECT DISTINCT src AS node, src AS label FROM e), {steps}, f AS (SELECT node, label FROM l{n + 1} WHERE node IN (SELECT dst FROM e))"


@query(f"{rounds(5)} SELECT node, label FROM f")
def label_propagation(spark, sf):
    checkpoints(spark)
    return graph.label_propagation(_edges(spark, sf))


CLUSTERS = f"{rounds(15)}, c AS (SELECT label, count(*) AS count, list(node ORDER BY node) AS members FROM f GROUP BY label HAVING count(*) >= 2)"


@query(f"{CLUSTERS} SELECT * FROM c")
def label_clusters(spark, sf):
    checkpoints(spark)
    return graph.cluster(_edges(spark, sf))


@query(f"{CLUSTERS} SELECT label, unnest(members) AS node, count FROM c")
def cluster_members(spark, sf):
    checkpoints(spark)
    return graph.cluster_members(graph.label_propagation(_edges(spark, sf), 15))


@query(f"{CLUSTERS} SELECT vec_id, f.label AS cluster FROM embeddings LEFT JOIN f ON vec_id = node")
def labelled_vertices(spark, sf):
    checkpoints(spark)
    labels = graph.label_propagation(_edges(spark, sf), 15)
    return graph.labelled_vertices(t(spark, sf, "embeddings").select("vec_id"), labels, "vec_id").withColumnRenamed("label", "cluster")


@query(f"{CLUSTERS} SELECT coalesce(sum(count), 0)::BIGINT AS nodes, count(*) AS clusters, min(count) AS smallest, max(count) AS largest, round(avg(count), 6) AS mean, round(stddev(count), 6) AS deviation, quantile_cont(count, 0.25)::DOUBLE AS q1, quantile_cont(count, 0.5)::DOUBLE AS median, quantile_cont(count, 0.75)::DOUBLE AS q3 FROM c")
def cluster_stats(spark, sf):
    path = f"{checkpoints(spark)}/clusters-{uuid.uuid4().hex}"
    return graph.save_clusters(t(spark, sf, "embeddings").select("vec_id"), _edges(spark, sf), path, "vec_id").withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


# --- files -----------------------------------------------------------------------------------------------------------
@query(f"WITH {SEQS} SELECT id::VARCHAR AS seq_id, concat('document ', id) AS \"desc\", seq AS sequence, length(seq)::BIGINT AS length FROM s")
def fasta_round_trip(spark, sf):
    path = f"{checkpoints(spark)}/fasta-{uuid.uuid4().hex}"
    SR.write_fasta(seqs(spark, sf).select(F.concat_ws(" ", F.col("id").cast("string"), F.lit("document"), F.col("id").cast("string")).alias("name"), "seq"), path)
    return Fasta().load_small(spark, path).df.select("seq_id", "desc", "sequence", "length")


@query("SELECT concat('@', conv_id, '/', lpad(turn::VARCHAR, 4, '0')) AS name, regexp_replace(text, '\\s', '', 'g') AS seq, role AS qual FROM conversations")
def fastq_round_trip(spark, sf):
    path = f"{checkpoints(spark)}/fastq-{uuid.uuid4().hex}"
    SR.write_fastq(_pairs(spark, sf).withColumn("seq", F.regexp_replace("seq", r"\s", "")), path)
    return SR.fastq(spark, path).select("name", "seq", "qual")


@query("SELECT c_custkey::VARCHAR AS seq_id, c_mktsegment AS type, c_custkey AS \"start\", c_custkey + 10 AS \"end\", (CASE c_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END)::TINYINT AS strand, c_name AS name, concat('n', c_nationkey, '|m') AS notes FROM customer")
def gff3_scan(spark, sf):
    path = f"{checkpoints(spark)}/gff3-{uuid.uuid4().hex}.gff"
    sign = F.when(F.col("c_nationkey") % 3 == 0, "+").when(F.col("c_nationkey") % 3 == 1, "-").otherwise(".")
    k = F.col("c_custkey").cast("string")
    line = F.concat_ws("\t", k, F.lit("src"), "c_mktsegment", k, (F.col("c_custkey") + 10).cast("string"), F.lit("."), sign, F.lit("0"), F.concat(F.lit("ID="), "c_name", F.lit(";Note=n"), F.col("c_nationkey").cast("string"), F.lit(",m;")))
    t(spark, sf, "customer").select(line.alias("value")).write.text(path)
    d = Gff3().load_small(spark, path).df
    p = F.get("location", F.lit(0))
    return d.select("seq_id", "type", p["start"].alias("start"), p["end"].alias("end"), p["strand"].alias("strand"), loc.qualifier(F.col("qualifiers"), "ID").alias("name"), F.array_join(loc.values_of(F.col("qualifiers"), "Note"), "|").alias("notes"))


@query("SELECT o_orderkey AS ids, sample_name, CASE sample_name WHEN 'a' THEN concat(o_orderkey % 2, '|', o_orderkey % 3) ELSE '.' END AS gt FROM orders, (VALUES ('a'), ('b')) v(sample_name)")
def vcf_scan(spark, sf):
    path = f"{checkpoints(spark)}/vcf-{uuid.uuid4().hex}"
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    line = F.concat_ws("\t", F.lit("1"), k, k, F.lit("A"), F.lit("C,G"), F.lit("50"), F.lit("PASS"), F.lit("."), F.lit("GT"), F.concat_ws("|", (F.col("o_orderkey") % 2).cast("string"), (F.col("o_orderkey") % 3).cast("string")), F.lit("."))
    o.select(line.alias("value")).coalesce(1).write.text(f"{path}/body")
    head = ["##fileformat=VCFv4.2", "##note=a=b", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb"]
    spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.text(f"{path}/head")
    names = VcfHeader().load_small(spark, f"{path}/head").df.where("key = 'samples'").select(F.split("value", "\t").alias("names"))
    body = Vcf().load_small(spark, f"{path}/body").df
    named = body.select("file_path").distinct().crossJoin(names)
    return genotype.sample_rows(body, named).select(F.col("ids").cast("long").alias("ids"), "sample_name", "gt")


def scratch(spark, name: str) -> str:
    return f"{checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def _pair_files(spark, sf) -> str:
    path = scratch(spark, "pairs")
    t(spark, sf, "customer").select(F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name").alias("value")).repartition(3).write.text(path)
    return path


PAIRS = "SELECT c_custkey::VARCHAR AS key, c_name AS value, {0}::BIGINT AS n FROM customer"


def _counted(table):
    return table.df.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


@query(PAIRS.format(1))
def load_listed(spark, sf):
    path = _pair_files(spark, sf)
    files.write_text(spark, f"{path}.list", "\n".join(files.glob(spark, f"{path}/part-*")))
    return _counted(Pairs().load_listed(spark, f"{path}.list"))


@query(PAIRS.format(2))
def load_big(spark, sf):
    """Each file twice, kept as Parquet and taken from there the second time."""
    path = _pair_files(spark, sf)
    paths = files.glob(spark, f"{path}/part-*") * 2
    Pairs().load_big(spark, paths, f"{path}.kept")
    return _counted(Pairs().load_big(spark, paths, f"{path}.kept"))


@query(PAIRS.format(1))
def load_concatenated(spark, sf):
    path = _pair_files(spark, sf)
    B.concatenate(spark, f"{path}/part-*", f"{path}.cat", 2)
    return _counted(Pairs().load_concatenated(spark, f"{path}.cat"))


def _genbank(spark, sf) -> str:
    """A record for each supplier: a sequence of its number's length, one coding sequence and one gene."""
    path = scratch(spark, "genbank")
    k = F.col("s_suppkey")
    bases = F.substring(F.repeat(F.lit("atgcccgta"), 200), F.lit(1), (k % 700 + 30).cast("int"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("LOCUS       S"), k, F.lit("  "), k % 700 + 30, F.lit(" bp    DNA     linear   BCT 01-JAN-2020")), F.concat(F.lit("DEFINITION  "), "s_name", F.lit(".")), F.concat(F.lit("ACCESSION   S"), k), F.concat(F.lit("VERSION     S"), k, F.lit(".2")), F.lit("FEATURES             Location/Qualifiers"),
        F.concat(F.lit("     CDS             complement("), k % 7 + 1, F.lit(".."), k % 7 + 12, F.lit(")")), F.concat(F.lit('                     /locus_tag="t'), k, F.lit('"')), F.lit("                     /transl_table=11"), F.lit("     gene            join(1..3,5..9)"), F.concat(F.lit('                     /gene="'), "s_name", F.lit('"')),
        F.lit("ORIGIN"), F.concat(F.lit("        1 "), F.regexp_replace(bases, "(.{10})", "$1 ")), F.lit("//"),
    )
    t(spark, sf, "supplier").select(text.alias("value")).write.text(path)
    return path


@query("SELECT concat('S', s_suppkey, '.2') AS seq_id, s_name AS \"desc\", upper(substring(repeat('atgcccgta', 200), 1, s_suppkey % 700 + 30)) AS sequence, s_suppkey % 700 + 30 AS length FROM supplier")
def genbank_sequences(spark, sf):
    return GenBank("sequence").load_small(spark, _genbank(spark, sf)).df.select("seq_id", "desc", F.upper("sequence").alias("sequence"), "length")


@query(
    "SELECT concat('S', s_suppkey, '.2') AS seq_id, kind AS type, CASE kind WHEN 'CDS' THEN s_suppkey % 7 + 1 ELSE 1 END AS \"start\", CASE kind WHEN 'CDS' THEN s_suppkey % 7 + 12 ELSE 9 END AS \"end\", (CASE kind WHEN 'CDS' THEN -1 ELSE 1 END)::TINYINT AS strand, "
    "CASE kind WHEN 'CDS' THEN concat('t', s_suppkey) END AS tag, CASE kind WHEN 'gene' THEN s_name END AS gene FROM supplier, (VALUES ('CDS'), ('gene')) v(kind)"
)
def genbank_features(spark, sf):
    d = GenBank("annotation").load_small(spark, _genbank(spark, sf)).df
    p, q = F.get("location", F.lit(0)), F.col("qualifiers")
    return d.select("seq_id", "type", p["start"].alias("start"), p["end"].alias("end"), p["strand"].alias("strand"), loc.qualifier(q, "locus_tag").alias("tag"), loc.qualifier(q, "gene").alias("gene"))


@query("SELECT 'id' AS key, concat('S', s_suppkey, '.2') AS value, 1::BIGINT AS n FROM supplier UNION ALL SELECT 'description', s_name, count(*) FROM supplier GROUP BY 2 UNION ALL SELECT k, x, count(*) FROM supplier, (VALUES ('molecule_type', 'DNA'), ('topology', 'linear'), ('sequence_version', '2')) v(k, x) GROUP BY ALL")
def genbank_metadata(spark, sf):
    d = GenBank("metadata").load_small(spark, _genbank(spark, sf)).df
    return dedup.members(d, "key", ["id", "description", "molecule_type", "topology", "sequence_version"]).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat('@', conv_id, '/', lpad(turn::VARCHAR, 4, '0')) AS name, regexp_replace(text, '\\s', '', 'g') AS seq, role AS qual FROM conversations")
def fastq_split(spark, sf):
    path = scratch(spark, "fastq")
    SR.write_fastq(_pairs(spark, sf).withColumn("seq", F.regexp_replace("seq", r"\s", "")), path)
    return SR.fastq_split(spark, path).select("name", "seq", "qual")


@query("SELECT concat('@', conv_id, '/', lpad(turn::VARCHAR, 4, '0')) AS name, regexp_replace(text, '\\s', '', 'g') AS seq, role AS qual FROM conversations")
def fastq_lines(spark, sf):
    path = scratch(spark, "fastq")
    SR.write_fastq(_pairs(spark, sf).withColumn("seq", F.regexp_replace("seq", r"\s", "")), path)
    SR.convert(spark, path, f"{path}.lines", to="lines")
    return SR.fastq_lines(spark, f"{path}.lines").select("name", "seq", "qual")


@query("SELECT concat('@', conv_id, '/', lpad(turn::VARCHAR, 4, '0')) AS name, regexp_replace(text, '\\s', '', 'g') AS seq FROM conversations")
def fastq_to_parquet(spark, sf):
    """Converted, sorted by name, and loaded again; then as FASTA."""
    path = scratch(spark, "fastq")
    SR.write_fastq(_pairs(spark, sf).withColumn("seq", F.regexp_replace("seq", r"\s", "")), path)
    SR.convert(spark, path, f"{path}.pq", sort="name")
    SR.convert(spark, path, f"{path}.fa", to="fa")
    a, b = SR.load(spark, f"{path}.pq", format="pq"), SR.load(spark, f"{path}.fa", format="fa")
    return a.select("name", "seq").join(b.select(F.concat(F.lit("@"), "name").alias("name"), "seq"), ["name", "seq"])


@query("SELECT c_name AS name, concat(repeat('A', (c_custkey % 5)::INT), c_mktsegment) AS seq FROM customer")
def sam_scan(spark, sf):
    path = scratch(spark, "sam")
    seq = F.concat(F.repeat(F.lit("A"), (F.col("c_custkey") % 5).cast("int")), "c_mktsegment")
    line = F.concat_ws("\t", "c_name", F.lit("4"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), seq, F.lit("I"))
    t(spark, sf, "customer").select(line.alias("value")).union(spark.createDataFrame([("@HD\tVN:1",)], "value string")).write.text(path)
    return SR.sam(spark, path).select("name", "seq")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def tsv_vertices(spark, sf):
    path = scratch(spark, "tsv")
    SR.write_tsv(t(spark, sf, "nation"), path)
    return SR.vertices(spark, path, "TSV", "n_nationkey int, n_name string, n_regionkey int")


def _metadata(spark, sf):
    i = F.col("c_custkey")
    return t(spark, sf, "customer").select(F.col("c_mktsegment").alias("file_path"), F.col("c_name").alias("key"), F.when(i % 4 > 0, i.cast("string")).alias("value"))


@query("SELECT c_mktsegment AS file_path, c_name AS key, c_custkey::VARCHAR AS value FROM customer WHERE c_custkey % 4 > 0")
def typed_round_trip(spark, sf):
    """Written with its sidecar, read by its class, the valid rows written over it, read again."""
    path = scratch(spark, "typed")
    Metadata(_metadata(spark, sf)).write(path)
    Metadata.read(spark, path).valids().write(path, overwrite=True)
    return Metadata.read(spark, path).df.drop("idx")


@query("SELECT a.n_regionkey AS file_path, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY 1")
def relation_self_join(spark, sf):
    m = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), "n_regionkey")
    a, b = m.select(F.col("idx").alias("idx_1"), "n_regionkey"), m.select(F.col("idx").alias("idx_2"), "n_regionkey")
    pairs = Relation(a.join(b, "n_regionkey").select("idx_1", "idx_2")).valids().df
    return pairs.join(a.withColumnRenamed("n_regionkey", "file_path"), "idx_1").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {SEQS}, r AS (SELECT id, seq, id % 3 = 0 AND length(seq) > 0 AS a, id % 2 = 0 AS b FROM s) "
    "SELECT count(*) FILTER (a) AS reads, count(*) FILTER (a AND b) AS pairs FROM r"
)
def read_validators(spark, sf):
    """A third of the reads have as many qualities as letters; every second mate (which may be empty) too."""
    i, n = F.col("id"), F.length("seq")
    some = lambda k: F.transform(F.sequence(F.lit(0), k), lambda x: F.lit(1).cast("tinyint"))
    d = seqs(spark, sf).select("id", F.col("seq").alias("sequence"), n.cast("long").alias("length"), F.when(i % 3 == 0, F.slice(some(n), F.lit(1), n)).otherwise(some(n)).alias("quality"))
    d = d.withColumns({"sequence_2": F.lit("").cast("string"), "length_2": F.when(i % 2 == 0, 0).otherwise(1).cast("long"), "quality_2": F.array().cast("array<tinyint>")})
    return d.agg(F.count_if(Reads._valid()).alias("reads"), F.count_if(PairedReads._valid()).alias("pairs"))


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey % 4 > 0) AS metadata, (SELECT count(*) FROM customer WHERE c_nationkey > 3) AS relations, (SELECT count(*) FROM events WHERE value > 50) AS features, (SELECT count(*) FROM part WHERE p_size > 9) AS cds")
def other_validators(spark, sf):
    count = lambda df, cls, n: df.agg(F.count_if(cls._valid()).alias(n))
    a = count(_metadata(spark, sf), Metadata, "metadata")
    b = count(t(spark, sf, "customer").select(F.col("c_custkey").alias("idx_1"), F.when(F.col("c_nationkey") > 3, F.col("c_custkey")).alias("idx_2")), Relation, "relations")
    c = count(t(spark, sf, "events").select(F.when(F.col("value") > 50, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("location")), Features, "features")
    d = count(t(spark, sf, "part").select(F.when(F.col("p_size") > 9, F.col("p_name")).alias("aa_sequence")), Cds, "cds")
    return a.crossJoin(b).crossJoin(c).crossJoin(d)


@query("SELECT count(*) FILTER (l_returnflag IN ('A', 'R')) AS among, count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS others, count(*) FILTER (l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)) AS joined FROM lineitem")
def membership(spark, sf):
    d = t(spark, sf, "lineitem")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    small = t(spark, sf, "part").where("p_size < 10").select("p_partkey")
    return n(dedup.members(d, "l_returnflag", ["A", "R"]), "among").crossJoin(n(dedup.members(d, "l_returnflag", ["A", "R"], negate=True), "others")).crossJoin(n(dedup.members(d, "l_partkey", small), "joined"))


# --- variants: the joins of a risk score -----------------------------------------------------------------------------
def _catalog(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("ids"), F.get(F.array(F.lit("O"), F.lit("F"), F.lit("LOW")), F.col("p_size") % 3).alias("alt"), (F.col("p_size") / 10).cast("float").alias("OR"), (F.col("p_size") % 25 + 1).alias("chromosome"), (F.col("p_partkey") % 500).alias("position"), F.col("p_brand").alias("trait"), F.lit(None).cast("date").alias("date"), F.col("p_partkey").alias("pubmedID"))


CATALOG = "c AS (SELECT p_partkey AS ids, (['O', 'F', 'LOW'])[p_size % 3 + 1] AS alt, p_size % 25 + 1 AS chromosome, p_partkey % 500 AS position, p_brand AS trait, p_partkey AS \"pubmedID\" FROM part)"


@query(f"WITH {CATALOG}, {VARIANTS}, a AS (SELECT ids, unnest(range(0, len(al)))::INT AS code, unnest(al) AS alt FROM v) SELECT ids, alt, trait, code FROM c JOIN (SELECT DISTINCT * FROM a) USING (ids, alt)")
def catalog_codes(spark, sf):
    return genotype.code_catalog(_catalog(spark, sf), _variants(spark, sf)).select("ids", "alt", "trait", "code")


@query(f"WITH {CATALOG}, ref AS (SELECT (o_custkey % 25 + 1)::INT AS chromosome, o_orderkey % 500 AS position, min(o_orderkey + 1000000) AS new FROM orders GROUP BY 1, 2) SELECT new AS ids, alt, trait, \"pubmedID\" FROM c JOIN ref USING (chromosome, position) QUALIFY row_number() OVER (PARTITION BY trait, new, alt ORDER BY \"pubmedID\") = 1")
def catalog_ids(spark, sf):
    ref = t(spark, sf, "orders").select((F.col("o_custkey") % 25 + 1).cast("int").alias("chromosome"), (F.col("o_orderkey") % 500).alias("position"), (F.col("o_orderkey") + 1000000).alias("ids"))
    return genotype.catalog_ids(_catalog(spark, sf), ref, overwrite=True).select("ids", "alt", "trait", "pubmedID")


@query("SELECT p_partkey AS ids, p_brand AS trait, (CASE WHEN p_size % 2 = 0 THEN (p_size % 4 + 5) ELSE 0 END)::INT AS code FROM part")
def catalog_mapped(spark, sf):
    p = t(spark, sf, "part")
    c = p.select(F.col("p_partkey").alias("ids"), F.col("p_brand").alias("trait"), (F.col("p_size") % 4).alias("code"))
    m = p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("ids"), (F.col("p_size") % 4).alias("code"), (F.col("p_size") % 4 + 5).alias("code1k"))
    return genotype.mapped_codes(c, m)


@query(
    "WITH g AS (SELECT l_partkey AS ids, concat('s', l_suppkey) AS sample_name, unnest([l_linenumber % 3, CAST(l_quantity AS BIGINT) % 2])::INT AS code FROM lineitem) "
    "SELECT sample_name, ids AS \"rsID\", (CASE WHEN code = p_size % 3 THEN 7 ELSE 0 END)::INT AS code, count(*)::DOUBLE AS dose FROM g LEFT JOIN part ON ids = p_partkey GROUP BY ALL"
)
def remapped_dose(spark, sf):
    m = t(spark, sf, "part").select(F.col("p_partkey").alias("ids"), (F.col("p_size") % 3).alias("code1k"), F.lit(7).alias("code"))
    return genotype.doses(_genotypes(spark, sf), m)


@query(
    "SELECT sample_name, concat('t', o_custkey % 10) AS trait, round(sum(CASE sample_name WHEN 'a' THEN (o_orderkey % 2) + 1 ELSE 1 END * (o_orderkey % 5 + 1)), 4)::DOUBLE AS prs_score FROM orders, (VALUES ('a'), ('b')) v(sample_name) "
    "WHERE o_totalprice >= 100000 AND o_orderstatus <> 'P' GROUP BY ALL"
)
def risk_plan(spark, sf):
    """Variants, header and catalog up to scores; samples a (1|0 or 1|1) and b (1|0)."""
    o, k = t(spark, sf, "orders"), F.col("o_orderkey")
    lit = lambda x: F.lit(x).cast("string")
    gt = F.array(F.concat(F.lit("1|"), (k % 2).cast("string")), F.lit("0|1"))
    v = o.select(lit("f").alias("file_path"), lit("1").alias("chromosome"), k.cast("string").alias("position"), F.concat(F.lit("rs"), k).alias("ids"), lit("A").alias("references"), lit("C").alias("alts"), F.col("o_totalprice").cast("string").alias("qual"), F.when(F.col("o_orderstatus") == "P", "low").otherwise("PASS").alias("filter"), lit(".").alias("info"), lit("GT").alias("format"), gt.alias("samples"))
    head = spark.createDataFrame([("f", "samples", "a\tb")], "file_path string, key string, value string")
    c = o.select(k.alias("ids"), lit("C").alias("alt"), (k % 5 + 1).cast("float").alias("OR"), F.lit(1).alias("chromosome"), k.alias("position"), F.concat(F.lit("t"), F.col("o_custkey") % 10).alias("trait"), F.lit(None).cast("date").alias("date"), F.lit(1).cast("long").alias("pubmedID"))
    return risk.scores(v, head, c, min_quality=100000, only_pass=True).select("sample_name", "trait", F.round("prs_score", 4).alias("prs_score"))


# --- gene clusters, vectors, tools -----------------------------------------------------------------------------------
@query("WITH m AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY ALL), p AS (SELECT DISTINCT a.user_id AS a, a.user_id + 1 AS b FROM m a), k AS (SELECT p.a, p.b, e.event_type, coalesce(x.v, 0) AS x, coalesce(y.v, 0) AS y FROM p CROSS JOIN (SELECT DISTINCT event_type FROM events) e LEFT JOIN m x ON x.user_id = p.a AND x.event_type = e.event_type LEFT JOIN m y ON y.user_id = p.b AND y.event_type = e.event_type) SELECT a, round(sqrt(sum((x - y) * (x - y))), 6) AS distance FROM k WHERE b IN (SELECT user_id FROM m) GROUP BY a")
def sparse_distance(spark, sf):
    v = features.vectors(t(spark, sf, "events").select(F.col("user_id").alias("bgc_id"), F.col("event_type").alias("key"), "value"))
    a, b = v.select(F.col("bgc_id").alias("a"), F.col("features").alias("x")), v.select((F.col("bgc_id") - 1).alias("a"), F.col("features").alias("y"))
    return a.join(b, "a").select("a", F.round(vec.sparse_distance(F.col("x"), F.col("y")), 6).alias("distance"))


@query("SELECT p_partkey AS cds_id, substring(p_name, 2, p_size % 6 + 1) AS aa FROM part WHERE p_size < 40")
def hit_sequences(spark, sf):
    p = t(spark, sf, "part")
    cds = p.select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("aa_sequence"))
    hits = p.where("p_size < 40").select(F.col("p_partkey").alias("cds_id"), F.lit(2).cast("long").alias("cds_from"), (F.col("p_size") % 6 + 2).cast("long").alias("cds_to"))
    return features.hit_sequences(hits, cds).select("cds_id", "aa")


@query("SELECT p_partkey AS cds_id, 1::BIGINT AS cds_from, length(p_name)::BIGINT AS cds_to, m AS hmm_acc, length(regexp_replace(p_name, concat('[^', m, ']'), '', 'g'))::FLOAT AS bitscore FROM part, (VALUES ('a'), ('e')) v(m) WHERE contains(p_name, m)")
def domain_scan(spark, sf):
    """A pluggable scorer that counts a letter stands for the profiles."""

    def scorer():
        return lambda s: [(1, len(s), m, m, float(s.count(m))) for m in "ae" if m in s]

    cds = t(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("aa_sequence"))
    return P.scan_domains(cds, scorer).drop("hmm_name")


@query("SELECT c_mktsegment AS seq_id, count(*) AS members FROM customer WHERE c_custkey % 1000 >= 1 AND c_custkey % 1000 + 10 <= 800 GROUP BY 1")
def cluster_database(spark, sf):
    """Coding sequences within one cluster a contig, in a database that is created, loaded and asked."""
    box = lambda a, b: F.array(F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(False).alias("start_partial"), F.lit(False).alias("end_partial"), F.lit(1).cast("tinyint").alias("strand")))
    none = F.array().cast("array<struct<key:string,values:array<string>>>")
    c = t(spark, sf, "customer")
    at = F.col("c_custkey") % 1000
    cds = c.select(F.lit("f").alias("file_path"), F.lit("f").alias("source_path"), F.col("c_mktsegment").alias("seq_id"), F.lit("CDS").alias("type"), box(at, at + 10).alias("location"), none.alias("qualifiers"))
    product = F.array(F.struct(F.lit("product").alias("key"), F.array(F.lit("PKS")).alias("values")))
    regions = c.select("c_mktsegment").distinct().select(F.lit("f"), F.lit("f"), "c_mktsegment", F.lit("region"), box(F.lit(1), F.lit(800)), product)
    path = scratch(spark, "database")
    P.ClusterDatabase.create(spark, path, features=cds.union(regions))
    db = P.ClusterDatabase.load(spark, path)
    return db.members().join(db.get("clusters").df.select(F.col("idx").alias("bgc_id"), "seq_id"), "bgc_id").groupBy("seq_id").agg(F.count(F.lit(1)).alias("members"))


@query("SELECT count(*) FILTER (n_nationkey % 5 = 0) AS skipped, count(*) FILTER (n_nationkey % 5 = 1) AS failed, count(*) FILTER (n_nationkey % 5 > 1) AS succeeded FROM nation")
def runner_tally(spark, sf):
    def task(path, output, params):
        n = int(path.rpartition("/")[2])
        if n % 5 == 1:
            raise RuntimeError(path)
        return -1 if n % 5 == 0 else 1

    paths = [f"in/{r.n_nationkey}" for r in t(spark, sf, "nation").collect()]
    return R.tally(runner.run_files(spark, paths, "out", task))
