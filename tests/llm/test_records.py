import random
import zlib

import numpy as np
import pytest

import public_tokenizers
from strandlake.llm import records
from strandlake.llm import tokens
from strandlake.llm.tokens import Encoder
from strandlake.llm.textops import blocks
from tokenizers import Tokenizer

from .data import nasty, nothing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    import pyarrow as pa

    random.seed(3)
    letters = list("ab Z.,'\n  \t09éß×  中 !?'s#%—é́≮")
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", " ", "\n\n\n", "0 00 0", "x" * 3000, "don't we'll I'M"]
    encode, whole = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    got = []
    for _, data, offsets in blocks(pa.array(texts, pa.string()), 4000):
        ids, first = encode(data, offsets)
        got += [ids[first[k] : first[k + 1]].tolist() for k in range(len(offsets) - 1)]
    assert got == [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def ids_of(encode, texts, size=2000):
    import pyarrow as pa

    out = []
    for _, data, offsets in blocks(pa.array(texts, pa.string()), size):
        ids, first = encode(data, offsets)
        out += [ids[first[k] : first[k + 1]].tolist() for k in range(len(offsets) - 1)]
    return out


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_of_one_spelling_are_learnt_once(name, monkeypatch):
    """Capitals, spaces before words, letters with marks, and pieces that are forgotten and met again."""
    random.seed(5)
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    parts = ["Word", "word", " word", " WORD", "été", " Été", "ÉTÉ", "ß", "ÿ", "µª", "H\u0331", "h\u0331", "İ", "K", "Σς", "'S", "'s", "n't", "0", " 0", " 10a", "\n", "  ", " \t", ".", "x" * 30]
    texts = ["".join(random.choice([*parts, *(" " + random.choice("abCé") * k for k in range(1, 30))]) for _ in range(random.randint(0, 12))) for _ in range(3000)]
    encode, whole = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    assert ids_of(encode, texts) == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert encode.old.n > 40
    if name.startswith("word"):
        encode = Encoder(public_tokenizers.path(name))
        assert len(ids_of(encode, ["Word word WORD wOrD"])[0]) == 4 * len(whole.encode("word", add_special_tokens=False).ids)
        assert encode.young.n == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_in_texts(name):
    """What looks like a special token in a text has the ids that the tokenizer gives it."""
    encode, whole = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    texts = ["plain", "", "a <|endoftext|> b", "x<|startoftext|>y", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "plain again"]
    assert ids_of(encode, texts) == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def expected(rows):
    whole, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, tmp_path):
    docs = nasty(spark).repartition(3)
    manifest = records.write_records(docs, f"{tmp_path}/shards", PATH)
    rows = sorted(records.read_records(manifest).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == expected([(r.doc_id, r.text) for r in docs.collect()])
    files = {r.shard: r.file for r in manifest.collect()}
    for r in random.Random(1).sample(rows, 6):  # shuffled reads through the index
        doc_id, ids = records.read_record(files[r.shard], r.record)
        assert (doc_id, zlib.crc32(ids.tobytes())) == (r.doc_id, r.ids_crc32)
    assert records.read_records(records.write_records(nothing(spark), f"{tmp_path}/none", PATH)).count() == 0


def test_damage_is_found(tmp_path):
    data = bytearray(b"".join(records.frame(records.pack(d, np.arange(d, 70000, 999))) for d in (1, 2, 3)))
    path = tmp_path / "000000.rec"
    path.write_bytes(data)
    assert [d for d, _ in records.stream(str(path), 64)] == [1, 2, 3]
    for at in (0, 9, 14, 30, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        path.write_bytes(broken)
        with pytest.raises(records.Damaged):
            list(records.stream(str(path), 64))
    path.write_bytes(data[:-3])
    with pytest.raises(records.Damaged):
        list(records.stream(str(path), 64))


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = records.op7_binary_records(spark, sf).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == expected([(r.doc_id, r.text) for r in docs.collect()])
