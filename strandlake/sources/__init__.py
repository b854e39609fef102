"""Readers and writers: FASTA, FASTQ, SAM, GenBank, GFF3, VCF, association catalogs, delimited text."""
