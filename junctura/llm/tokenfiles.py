"""Operator 6: token ids in fixed-width bit-packed files.

A *block group* holds whole documents that follow each other in id order: their bit-packed ids and the index needed to
find any of them. Groups are rows of a Parquet table, so that Spark's commit protocol makes the files survive lost
executors and any store that Spark writes to will do; the payload is the format proper:

* every id takes ``bits`` bits, most significant bit first, ``bits`` being the least that hold the vocabulary;
* ids are cut into blocks of ``BLOCK`` ids, each starting on a byte, so id ``i`` of a group is found from
  ``block_offsets[i // BLOCK]`` without reading the blocks before it;
* ``doc_starts[k]`` is the position in the group of document ``k``'s first id.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.remembered import KEY_LENGTH, Remembered, per_worker
from junctura.llm.scratch import new_path, shuffle_partitions

BLOCK = 1024
#: Ids after which a group is closed; one document may exceed it, as documents are not cut.
GROUP_IDS = 1 << 18
#: Texts encoded together.
TOGETHER = 1_000


def bits_for(vocab_size: int) -> int:
    """The least number of bits that hold ids 0 to vocab_size - 1."""
    return max(1, int(vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` with ``bits`` bits each, most significant first, filled up to a byte with zeros."""
    ids = np.asarray(ids, dtype=np.uint32)
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    if bits == 16:
        return ids.astype(">u2").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids[:, None] >> shifts) & 1).astype(np.uint8).ravel()).tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of ``data``."""
    if bits == 16:
        return np.frombuffer(data, dtype=">u2", count=n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits).reshape(n, bits)
    weights = (1 << np.arange(bits - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
    return (flat.astype(np.uint64) @ weights).astype(np.uint32)


def pack_blocks(ids: np.ndarray, bits: int) -> tuple[bytes, np.ndarray]:
    """The payload of a group and the byte offset of each block."""
    parts = [pack_bits(ids[k : k + BLOCK], bits) for k in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int64)[:-1] if parts else np.zeros(0, np.int64)
    return b"".join(parts), offsets


def read_ids(payload: bytes, block_offsets: np.ndarray, bits: int, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a group; only the blocks that hold them are unpacked."""
    if n == 0:
        return np.zeros(0, np.uint32)
    out = []
    for block in range(start // BLOCK, (start + n - 1) // BLOCK + 1):
        lo, hi = max(start - block * BLOCK, 0), min(start + n - block * BLOCK, BLOCK)
        first = lo * bits // 8
        skip = lo - first * 8 // bits if bits == 16 else lo
        at = int(block_offsets[block]) + (first if bits == 16 else 0)
        out.append(unpack_bits(payload[at : at + (BLOCK * bits + 7) // 8], bits, skip + hi - lo)[skip:])
    return np.concatenate(out)


#: Letters that are alone in their normal form and have one lower-case letter, then ASCII without letters.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(f"([{LETTERS}]+)([!-@\\[-`{{-~]*)")


class ChunkedTokenizer:
    """The ids that a ``tokenizers`` model gives a text, made from the ids of its stretches without white space.

    Valid for models that drop white space before their merges, let no token span it and mark the last token of a word.
    The distinct stretches of some texts are found by Arrow; new ones are encoded by the library and remembered.
    """

    WORD_END = "</w>"

    def __init__(self, model_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model_json)
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(self.WORD_END)]] = True
        self.known: Remembered = Remembered(lambda s: self._ids(s).tobytes())
        self.tails: Remembered = Remembered(lambda s: self._ids(s).tobytes(), 50_000)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def learn(self, words: list[str]) -> None:
        """Remember the ids of new stretches; those that are plain letters and a tail without letters all at once.

        Such a stretch is two lots of the model's words, as letters are one word to it, which the last of their ids
        shows to end. Others are encoded by themselves when they are asked for.
        """
        plain = [(word, *found.groups()) for word in words if (found := PLAIN.fullmatch(word)) and len(word) <= KEY_LENGTH]
        self.tails.turn()
        for k in range(0, len(plain), 4096):
            part, stems, tails = zip(*plain[k : k + 4096], strict=True)
            ids = self._ids(" ".join(stems))
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                data, cuts = ids.tobytes(), [0, *(4 * stops).tolist()]
                encoded = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                self.known.update(zip(part, map(bytes.__add__, encoded, map(self.tails.__getitem__, tails)), strict=True))

    def encode_many(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of each text, followed by ``end_id``. It is cut at ASCII white space; the library sees any other kind."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.known.turn()
        found = list(map(self.known.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        self.learn([words[k] for k in new if words[k] not in self.known.older])
        for k in new:
            found[k] = self.known[words[k]]
        found.append(np.uint32(end_id).tobytes())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), dtype=np.uint32)
        after = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        at = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), after, len(words))
        taken = sizes[at]
        stops = np.cumsum(taken)
        flat = ids[np.repeat(starts[at] - stops + taken, taken) + np.arange(stops[-1] if len(stops) else 0)]
        return np.split(flat, stops[after + np.arange(len(after))][:-1]) if len(after) else []


def tokenizer_for(model_json: str) -> ChunkedTokenizer:
    """One tokenizer for all tasks that a Python worker runs, with what it remembers."""
    return per_worker("words", zlib.crc32(model_json.encode()), lambda: ChunkedTokenizer(model_json))


FILE_SCHEMA = (
    "shard int, seq int, bits int, n_ids long, doc_ids array<long>, doc_starts array<long>, block_offsets array<long>, payload binary"
)


def write_token_files(
    docs: DataFrame, path: str, model_json: str, end_id: int, vocab_size: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None
) -> None:
    """Encode every text and write the ids to ``path`` in ascending order of ``id_col``.

    Documents are range-partitioned by id, so ``shard`` and ``seq`` give the order of the whole corpus.

    * null and empty texts have the end id alone;
    * null ids come first; rows that repeat an id stay, in the order of their texts;
    * an empty table gives an empty file set;
    * only the two named columns are read, so extra ones may have any name.
    """
    spark = docs.sparkSession
    bits = bits_for(vocab_size)
    model = spark.sparkContext.broadcast(model_json)  # the vocabulary file, fixed in size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(shards or shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, shard, seq = tokenizer_for(model.value), TaskContext.get().partitionId(), 0
        ids: list = []
        arrays: list[np.ndarray] = []

        def group() -> pa.RecordBatch:
            flat = np.concatenate(arrays)
            payload, offsets = pack_blocks(flat, bits)
            starts = np.cumsum([0, *map(len, arrays)])[:-1]
            row = {"shard": shard, "seq": seq, "bits": bits, "n_ids": len(flat), "doc_ids": ids, "doc_starts": starts.tolist(), "block_offsets": offsets.tolist(), "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        held = 0
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                for doc_id, got in zip(part.column(0).to_pylist(), tokenizer.encode_many(part.column(1), end_id), strict=True):
                    if arrays and held + len(got) > GROUP_IDS:
                        yield group()
                        seq, held, ids, arrays = seq + 1, 0, [], []
                    ids.append(doc_id)
                    arrays.append(got)
                    held += len(got)
        if arrays:
            yield group()

    schema = pa.schema([
        ("shard", pa.int32()), ("seq", pa.int32()), ("bits", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("doc_starts", pa.list_(pa.int64())), ("block_offsets", pa.list_(pa.int64())), ("payload", pa.binary()),
    ])
    ordered.mapInArrow(encode, FILE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32, ids``.

    ``start`` counts the ids of all documents before it in the corpus. The totals of the shards, one row each, are
    summed up by a window; everything else is done where the groups lie.
    """
    from pyspark.sql import Window

    groups = spark.read.schema(FILE_SCHEMA).parquet(path)
    shards = groups.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("shard_base"))
    heads = groups.select("shard", "seq", "n_ids")
    in_shard = heads.select("shard", "seq", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_ids")).alias("seq_base"))
    bases = in_shard.join(before, "shard").select("shard", "seq", (F.col("shard_base") + F.col("seq_base")).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                starts = [*row["doc_starts"], row["n_ids"]]
                out: dict[str, list] = {"shard": [], "seq": [], "doc_id": [], "offset": [], "n_tokens": [], "ids_crc32": []}
                offsets = np.array(row["block_offsets"])
                for k, doc_id in enumerate(row["doc_ids"]):
                    ids = read_ids(row["payload"], offsets, row["bits"], starts[k], starts[k + 1] - starts[k])
                    for name, value in (("shard", row["shard"]), ("seq", row["seq"]), ("doc_id", doc_id), ("offset", starts[k]), ("n_tokens", len(ids)), ("ids_crc32", zlib.crc32(ids.astype("<u4").tobytes()))):
                        out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    read = groups.mapInArrow(documents, "shard int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return read.join(bases, ["shard", "seq"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def fetch_ids(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """Random access: the ids of one document, unpacking only its own blocks."""
    row = spark.read.schema(FILE_SCHEMA).parquet(path).where(F.array_contains("doc_ids", doc_id)).first()
    if row is None:
        raise KeyError(doc_id)
    k = row["doc_ids"].index(doc_id)
    starts = [*row["doc_starts"], row["n_ids"]]
    return read_ids(bytes(row["payload"]), np.array(row["block_offsets"]), row["bits"], starts[k], starts[k + 1] - starts[k]).tolist()


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model_json = f.read()
    path = new_path(spark, "token-files")
    vocab = Tokenizer.from_str(model_json).get_vocab_size()
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, model_json, end_id=2, vocab_size=vocab)
    return read_token_files(spark, path)
