"""Bit packing, and files against whole-text encoding by the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from junctura.llm.tokenfiles import ChunkedTokenizer, bits_for, fetch_ids, pack_blocks, read_ids, read_token_files, write_token_files

JSON = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


@pytest.mark.parametrize("bits", [1, 3, 11, 15, 16, 17, 20])
def test_any_stretch_reads_back(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 5000).astype(np.uint32)
    payload, offsets = pack_blocks(ids, bits)
    assert len(payload) <= 5000 * bits / 8 + len(offsets)
    for start, n in ((0, 5000), (1023, 2), (1024, 1024), (7, 0), (4999, 1), (100, 3000)):
        assert (read_ids(payload, offsets, bits, start, n) == ids[start : start + n]).all()


def test_least_bits():
    assert [bits_for(n) for n in (1, 2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        pack_blocks(np.array([8]), 3)


def test_stretches_match_whole_texts():
    whole, ours = Tokenizer.from_str(JSON), ChunkedTokenizer(JSON)
    rng = random.Random(5)
    parts = ["The", "don't", "it's,", "ÉTÉ", "Straße", "naïve.", "x1y", "12", "!!", "\x01", "a\x01b", " ", "é", "日本", "ΣΑΣ", "İx", "\x1c!", "_a_", "×", "ÿ", "Ñandú;", "<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|>"]
    texts = [rng.choice(["", " ", "\n", " "]).join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(2500)]
    for text, got in zip(texts, ours.encode_many(pa.array(texts), 2), strict=True):
        assert got.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2], repr(text)


def test_special_tokens_as_the_library_has_them():
    texts = ["hello <|endoftext|> world", "<|startoftext|>", "a<|endoftext|>'s\tb"]
    got = [x.tolist() for x in ChunkedTokenizer(JSON).encode_many(pa.array(texts), 2)]
    assert got == [[*Tokenizer.from_str(JSON).encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert got[0] == [3306, 49407, 1002, 2]


def test_files(spark, tmp_path):
    texts = ["b c", None, "", "long " * 200_000, "b c", "a"]
    rows = [(5, texts[0]), (3, texts[1]), (9, texts[2]), (7, texts[3]), (5, texts[4]), (None, texts[5])]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    path = f"file://{tmp_path}/ids"
    write_token_files(df, path, JSON, end_id=2, vocab_size=49_408, shards=3)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, path).collect()), key=lambda r: r[2])
    model, start, expected = Tokenizer.from_str(JSON), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i is not None, i or 0, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    assert fetch_ids(spark, path, 3) == [2]
    empty = f"file://{tmp_path}/none"
    write_token_files(df.limit(0), empty, JSON, end_id=2, vocab_size=49_408)
    assert read_token_files(spark, empty).count() == 0
