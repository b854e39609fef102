"""Operator 7: token ids as length-delimited binary records with an offset index.

A shard is a file of records, in ascending doc_id order; a later shard's doc_ids are not smaller. All numbers are
little-endian. A record is

    length of the payload, 8 bytes | masked checksum of those 8 bytes, 4 | payload | masked checksum of the payload, 4

and its payload is a flag byte (1: the doc_id is null), the doc_id (8 bytes, signed), the bytes in an id (1 byte: 2 or 4)
and the ids. The checksum is CRC-32, masked as ((crc >> 15 | crc << 17) + 0xa282ead8) mod 2^32, so that a checksum of
data that holds checksums stays sound. Beside each shard lies its index: for each record its offset and length in the
shard (8 bytes each), for shuffled reads of single records. Files are written under a temporary name and renamed, so a
repeated task leaves one whole file.

Nulls: a null text is empty and has the end id alone; null doc_ids come first. Repeated rows are repeated records, equal
doc_ids in the order of their texts. An empty table writes no shard. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, shared_dir
from .textops import blocks, tidy
from .tokens import ENCODED, encoder

HEAD, TAIL, INDEX = struct.Struct("<QI"), struct.Struct("<I"), np.dtype([("offset", "<u8"), ("length", "<u8")])
FACTS = struct.Struct("<BqB")


class Damaged(ValueError):
    """A record whose lengths or checksums do not fit."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, TAIL.pack(masked(length)), payload, TAIL.pack(masked(payload))))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[memoryview, int]:
    """The payload of the record at ``at``, and where the next record starts."""
    view = memoryview(data)
    if at + HEAD.size > len(view):
        raise Damaged(f"record at {at}: the file ends within its length")
    length, crc = HEAD.unpack_from(view, at)
    if crc != masked(view[at : at + 8]):
        raise Damaged(f"record at {at}: checksum of its length")
    end = at + HEAD.size + length
    if end + TAIL.size > len(view):
        raise Damaged(f"record at {at}: the file ends within its payload")
    payload = view[at + HEAD.size : end]
    if TAIL.unpack_from(view, end)[0] != masked(payload):
        raise Damaged(f"record at {at}: checksum of its payload")
    return payload, end + TAIL.size


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return FACTS.pack(doc_id is None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    none, doc_id, width = FACTS.unpack_from(payload)
    return None if none else doc_id, np.frombuffer(payload, f"<u{width}", offset=FACTS.size).astype("<u4")


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Writes the shards under ``path`` and returns their manifest: shard, file, n_records, n_tokens.

    ``tokenizer``: a tokenizers file that executors can read. ``shards``: as many as the input has partitions, if not
    given. Texts are dealt out by doc_id ranges, sorted, then encoded and written in a stream.
    """
    shards = shards or docs.rdd.getNumPartitions()

    @tidy
    def write(batches) -> Iterator:
        import pyarrow as pa

        shard = TaskContext.get().partitionId()
        fs, root = _filesystem(path)
        name, attempt = f"{root}/{shard:06d}", uuid.uuid4().hex
        encode, index, at, tokens, out = encoder(tokenizer), [], 0, 0, None
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, data, offsets in blocks(batch.column(1), ENCODED):
                ids, first = encode(data, offsets)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{name}.{attempt}.tmp")
                for k in range(len(offsets) - 1):
                    record = frame(pack(doc_ids[i + k], np.append(ids[first[k] : first[k + 1]], end_id)))
                    out.write(record)
                    index.append((at, len(record)))
                    at += len(record)
                tokens += len(ids) + len(offsets) - 1
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{name}.{attempt}.itmp") as f:
            f.write(np.array(index, INDEX).tobytes())
        fs.move(f"{name}.{attempt}.itmp", f"{name}.idx")
        fs.move(f"{name}.{attempt}.tmp", f"{name}.rec")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [f"{path}/{shard:06d}.rec"], "n_records": [len(index)], "n_tokens": [tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
    return cut(rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(write, "shard int, file string, n_records long, n_tokens long"))


def read_record(file: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its number in the shard, through the index: two short reads, whatever the shard's size."""
    fs, path = _filesystem(file)
    with fs.open_input_file(f"{path[:-4]}.idx") as f:
        f.seek(number * INDEX.itemsize)
        offset, length = np.frombuffer(f.read(INDEX.itemsize), INDEX)[0]
    with fs.open_input_file(path) as f:
        f.seek(int(offset))
        return unpack(unframe(f.read(int(length)))[0])


def stream(file: str, chunk: int = 8 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records of a shard in order, checked, with about ``chunk`` bytes (one record at least) in memory."""
    fs, path = _filesystem(file)
    rest = b""
    with fs.open_input_stream(path) as f:
        while True:
            more = f.read(chunk)
            data, at = rest + more, 0
            while at + HEAD.size <= len(data):
                if not more or at + HEAD.size + HEAD.unpack_from(data, at)[0] + TAIL.size <= len(data) or HEAD.unpack_from(data, at)[1] != masked(data[at : at + 8]):
                    payload, at = unframe(data, at)
                    yield unpack(payload)
                else:
                    break
            rest = data[at:]
            if not more:
                if rest:
                    raise Damaged(f"{file} ends within a record")
                return


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard, record: from the files.

    The manifest has a row for each shard; its running sum gives every shard's start.
    """
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, file, at in zip(pdf.shard, pdf.file, pdf.base, strict=True):
                rows = []
                for number, (doc_id, ids) in enumerate(stream(file)):
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), shard, number))
                    at += len(ids)
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "record"])
                yield out.astype({"doc_id": "Int64"})

    files = max(1, manifest.count())
    return based.repartition(files, "shard").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, record long")


def op7_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    return read_records(write_records(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json")))
