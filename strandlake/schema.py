"""Schemas of the typed tables. Column order is part of the contract; nullability is not."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


_QUALIFIERS = "ARRAY<STRUCT<key: STRING, `values`: ARRAY<STRING>>>"
_BOX = "STRUCT<start: BIGINT, `end`: BIGINT, strand: TINYINT>"
_SEQUENCE = "seq_id STRING, `desc` STRING, sequence STRING, length BIGINT"

COLUMNS = {
    "metadata": "key STRING, value STRING",
    "relation": "idx_1 BIGINT, idx_2 BIGINT",
    "sequence": _SEQUENCE,
    "read": f"{_SEQUENCE}, quality ARRAY<TINYINT>",
    "paired_read": f"{_SEQUENCE}, quality ARRAY<TINYINT>, sequence_2 STRING, length_2 BIGINT, quality_2 ARRAY<TINYINT>",
    "feature": f"source_path STRING, seq_id STRING, type STRING, location ARRAY<STRUCT<start: BIGINT, `end`: BIGINT, start_partial: BOOLEAN, end_partial: BOOLEAN, strand: TINYINT>>, qualifiers {_QUALIFIERS}",
    "cds": f"source_path STRING, seq_id STRING, location {_BOX}, locus_tag STRING, gene_name STRING, protein_name STRING, aa_sequence STRING, transl_table TINYINT, other_qualifiers {_QUALIFIERS}",
    "cluster": f"source_path STRING, seq_id STRING, location {_BOX}, classes ARRAY<STRING>, nt_seq STRING, on_contig_edge BOOLEAN, other_qualifiers {_QUALIFIERS}",
    "variant": "chromosome STRING, position STRING, ids STRING, references STRING, alts STRING, qual STRING, filter STRING, info STRING, format STRING, samples ARRAY<STRING>",
}

GWAS = "ids BIGINT, alt STRING, OR FLOAT, chromosome INT, position BIGINT, trait STRING, date DATE, pubmedID BIGINT"
READS = "id BIGINT, name STRING, seq STRING, plus STRING, qual STRING"
HITS = "cds_id BIGINT, cds_from BIGINT, cds_to BIGINT, hmm_acc STRING, hmm_name STRING, bitscore FLOAT"


def same(a: T.StructType, b: T.StructType) -> bool:
    """Equal names and types in the same order."""
    return [(f.name, f.dataType.simpleString()) for f in a.fields] == [(f.name, f.dataType.simpleString()) for f in b.fields]
