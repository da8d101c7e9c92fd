"""BAM as a source that splits and a sink, and other block-compressed (BGZF) text.

A BGZF file is a chain of small gzip members, each of which names its own size. A split begins at the first block after its
offset; as every task finds its own beginning and its successor's by the same rule, the driver looks at nothing but sizes. A
record may cross blocks: the first one of a split is where a chain of plausible records sets in that reaches the end of what
was unpacked.

The sink writes a folder of files in the order of contig and place, each a whole BAM whose blocks begin with a record, and
beside each a linear index: for every tile of TILE bases of a contig, the first block that holds a record over it. With it a
read of one contig, or of a part of one, begins at its first block and ends where records lie beyond.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from junctura.sources.readers import ALIGNMENT_TAGS

#: Compressed bytes of a split, unpacked bytes of a block and of what is decoded at once, bases of a tile, and lines of a batch.
SPLIT, BLOCK, STRETCH, TILE, ROWS = 32 << 20, 0xFF00, 2 << 20, 1 << 14, 10_000
#: So many plausible records one after the other are no accident.
CHAIN = 64
#: Fixed values of the format: the block that ends a file, letters of packed bases and of operations, a block's first bytes.
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BASES, OPERATIONS, MAGIC = "=ACMGRSVTWYHKDBN", "MIDNSHP=X", b"\x1f\x8b\x08\x04"
_FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mate_ref", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])
#: The letters of a byte of packed bases, and for a letter's byte the number of its base and of its operation.
_PAIRS = np.frombuffer("".join(a + b for a in BASES for b in BASES).encode(), np.uint8).reshape(256, 2)
_BASE_OF, _OPERATION_OF = np.full(256, 15, np.uint8), np.full(256, 255, np.uint8)
for _k, _c in enumerate(BASES):
    _BASE_OF[[ord(_c), ord(_c.lower())]] = _k
_OPERATION_OF[list(OPERATIONS.encode())] = np.arange(len(OPERATIONS))
#: Which operations go on along the contig: M, D, N, = and X.
_ALONG = np.array([op in "MDN=X" for op in OPERATIONS], np.int64)
_NAME = re.compile(rb"[!-~]*\0")
#: The columns of ``read_sam``.
SCHEMA = "read_id string, seg int, flag int, chr string, pos long, rev boolean, mapq int, cigar string, mate_chr string, mate_pos long, tlen long, seq string, qual string, " + ", ".join(ALIGNMENT_TAGS.values())


# --- blocks ------------------------------------------------------------------------------------------------------------


def pack_block(data: bytes, level: int = 6) -> bytes:
    """One BGZF block of at most BLOCK bytes."""
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    return MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def block_size(data: bytes, at: int) -> int:
    """Bytes of the block that begins there; 0 where none does, or its head isn't whole."""
    if data[at : at + 4] != MAGIC or len(data) < at + 18:
        return 0
    extra = struct.unpack_from("<H", data, at + 10)[0]
    place, stop = at + 12, at + 12 + extra
    while place + 4 <= min(stop, len(data) - 2):
        a, b, n = struct.unpack_from("<BBH", data, place)
        if (a, b, n) == (66, 67, 2):
            return struct.unpack_from("<H", data, place + 4)[0] + 1
        place += 4 + n
    return 0


class Blocks:
    """A BGZF file, block by block."""

    def __init__(self, path: str):
        system, inner = filesystem(path)
        self.file, self.size = system.open_input_file(inner), system.get_file_info(inner).size

    def first_from(self, offset: int) -> int:
        """Where the first block begins at or after an offset; the file's size if none does."""
        if offset <= 0:
            return 0
        while offset < self.size:
            data = self.file.read_at(min(1 << 17, self.size - offset), offset)
            for found in re.finditer(re.escape(MAGIC), data):
                at = offset + found.start()
                n = block_size(self.file.read_at(min(1 << 10, self.size - at), at), 0)
                # The block's end is another block's beginning, or the file's.
                if n and (at + n == self.size or self.file.read_at(4, at + n) == MAGIC):
                    return at
            offset += max(1, len(data) - 3)
        return self.size

    def blocks(self, at: int) -> Iterator[tuple[int, bytes]]:
        """Offset and content of each block from one on."""
        held, base, many = b"", at, 1 << 16  # what is read at once grows, as a header or a short split needs little
        while at < self.size:
            n = block_size(held, at - base)
            if not n or at - base + n > len(held):
                many = min(2 * many, 4 << 20)
                held, base = self.file.read_at(min(many, self.size - at), at), at
                n = block_size(held, 0)
                if not n or n > len(held):
                    raise ValueError(f"no whole block at {at}")
            start = at - base
            extra = struct.unpack_from("<H", held, start + 10)[0]
            yield at, zlib.decompress(held[start + 12 + extra : start + n - 8], -15)
            at += n


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]*:", path) else (fs.LocalFileSystem(), path)


def listed(path: str, ending: str) -> list[str]:
    """The files of a folder that its manifest names, or all with that ending; a file itself."""
    system, inner = filesystem(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    names = [x.base_name for x in system.get_file_info(fs.FileSelector(inner))]
    if "_manifest.json" in names:
        names = json.loads(system.open_input_file(f"{inner}/_manifest.json").read())
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names) if n.endswith(ending)]


@dataclass
class Split(InputPartition):
    """Part of a file by compressed offsets, and the contig and places asked for."""

    path: str
    start: int
    stop: int
    contig: str = ""
    first: int = 0
    last: int = -1


#: What is planned where there is nothing to read, as Spark wants a partition.
NOTHING = Split("", 0, 0)


def splits(path: str, ending: str, size: int) -> list[Split]:
    out = []
    for name in listed(path, ending):
        system, inner = filesystem(name)
        total = system.get_file_info(inner).size
        out += [Split(name, k, min(k + size, total)) for k in range(0, total, size)]
    return out


# --- lines -------------------------------------------------------------------------------------------------------------


def split_lines(path: str, start: int, stop: int) -> Iterator[bytes]:
    """The lines of a split: those that begin behind its first byte, up to the one that begins with the next split; a file's
    first line is its first split's."""
    blocks = Blocks(path)
    begin, end = blocks.first_from(start), blocks.first_from(stop)
    rest, skip = b"", begin > 0
    for at, data in blocks.blocks(begin) if begin < end else ():
        if at >= end:
            if skip:  # all of the split lies within a line that began before it
                return
            head, found, _ = data.partition(b"\n")
            rest += head
            if found:
                yield rest
                return
            continue
        if skip:
            _, found, data = data.partition(b"\n")
            if not found:
                continue
            skip = False
        *lines, rest = (rest + data).split(b"\n")
        yield from lines
    if rest:
        yield rest


class BgzfText(DataSource):
    """``file, block, at, value``: lines of block-compressed text; ``at`` counts a split's lines, ``block`` is its offset."""

    @classmethod
    def name(cls) -> str:
        return "bgzf_text"

    def schema(self) -> str:
        return "file string, block long, at long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _TextReader(self.options)


class _TextReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        return splits(self.path, "", self.split) or [NOTHING]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        done = 0

        def batch() -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(np.full(n, partition.start)), pa.array(np.arange(done, done + n)), pa.array(held)], names=["file", "block", "at", "value"])

        for line in split_lines(partition.path, partition.start, partition.stop) if partition.path else ():
            held.append(line.decode())
            if len(held) == ROWS:
                yield batch()
                done, held = done + len(held), []
        if held:
            yield batch()


# --- records -----------------------------------------------------------------------------------------------------------


def encode_header(contigs: list[tuple[str, int]]) -> bytes:
    text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in contigs)
    parts = [b"BAM\x01", struct.pack("<i", len(text)), text.encode(), struct.pack("<i", len(contigs))]
    for name, size in contigs:
        parts.append(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size))
    return b"".join(parts)


def read_header(blocks: Blocks) -> tuple[list[str], tuple[int, int]]:
    """Contigs' names, and the block and the place in it at which records begin."""
    data, sizes, names, size = b"", [], None, 0
    for at, block in blocks.blocks(0):
        sizes.append((at, len(block)))
        data += block
        if data[:4] != b"BAM\x01"[: len(data)]:
            raise ValueError("no BAM file")
        if names is None and (parsed := _parsed_header(data)):
            names, size = parsed
        if names is not None and size < len(data):
            return names, _place(sizes, size, blocks.size)
    if names is None:
        raise ValueError("no whole header")
    return names, (blocks.size, 0)


def _parsed_header(data: bytes) -> tuple[list[str], int] | None:
    """Contigs' names and the header's size, if it is there as a whole."""
    try:
        place = 8 + struct.unpack_from("<i", data, 4)[0]
        (many,), place = struct.unpack_from("<i", data, place), place + 4
        names = []
        for _ in range(many):
            size = struct.unpack_from("<i", data, place)[0]
            names.append(data[place + 4 : place + 3 + size].decode())
            place += 8 + size
    except struct.error:
        return None
    return (names, place) if place <= len(data) else None


def _place(sizes: list[tuple[int, int]], offset: int, end: int) -> tuple[int, int]:
    """Block and place in it of an offset into the content of blocks."""
    for at, size in sizes:
        if offset < size:
            return at, offset
        offset -= size
    return end, 0


def reach(cigar: str) -> int:
    return sum(int(n) for n, op in re.findall(r"(\d+)([MDN=X])", cigar or "")) or 1


def interval_bin(begin: int, end: int) -> int:
    """The number of the least of the format's nested intervals that holds [begin, end): of 2**14 bases, 2**17 and so on."""
    for shift in range(14, 29, 3):
        if begin >> shift == (end - 1) >> shift:
            return ((1 << (29 - shift)) - 1) // 7 + (begin >> shift)
    return 0


def encode_records(rows: pa.RecordBatch, numbers: dict[str, int]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The records of all rows at once, and for each the number of its contig (-1 if it has no place), its first base and the
    one behind its last."""
    n = rows.num_rows

    def text(c: str) -> pa.LargeStringArray:
        return pc.fill_null(rows.column(c).cast(pa.large_string()), "")

    def number(c: str, kind: pa.DataType, absent: int = 0) -> np.ndarray:
        return pc.fill_null(rows.column(c).cast(pa.int64()), absent).cast(kind).to_numpy(zero_copy_only=False)

    def contig(c: str) -> np.ndarray:
        known = pa.array([*numbers.values(), -1], pa.int32())
        return known.take(pc.fill_null(pc.index_in(text(c), pa.array(list(numbers), pa.large_string())), len(numbers))).to_numpy(zero_copy_only=False)

    name, seq, qual = (text(c) for c in ("read_id", "seq", "qual"))
    names = pc.binary_join_element_wise(pc.if_else(pc.equal(name, ""), "*", name).cast(pa.large_binary()), pa.scalar(b"\0", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    ops, n_ops, reaches = _operations(text("cigar"))
    seq = pc.replace_substring_regex(pc.if_else(pc.equal(seq, "*"), "", seq), r"[^\x00-\x7f]", "N")
    letters, l_seq = _flat(seq)
    half = (l_seq + 1) // 2
    halves = np.zeros(2 * half.sum(), np.uint8)
    halves[np.arange(len(letters)) + np.repeat(np.cumsum(2 * half - l_seq) - (2 * half - l_seq), l_seq)] = _BASE_OF[letters]
    told = pc.and_(pc.not_equal(qual, "*"), pc.equal(pc.utf8_length(qual), pa.array(l_seq)))
    scores, _ = _flat(pc.if_else(told, qual, ""))
    if ((scores < 33) | (scores > 127)).any():
        raise ValueError("a quality is no printable character")
    quality = np.full(l_seq.sum(), 255, np.uint8)
    quality[np.repeat(told.to_numpy(zero_copy_only=False), l_seq)] = scores - 33
    tags = [_encoded_tag(tag, rows.column(c.split()[0])) for tag, c in ALIGNMENT_TAGS.items() if c.split()[0] in rows.schema.names and rows.column(c.split()[0]).null_count < n]

    pos, fixed = number("pos", pa.int32(), -1).astype(np.int64), np.zeros(n, _FIXED)
    begins = np.maximum(pos, 0)
    values = {
        "ref": contig("chr"), "pos": pos, "l_name": _checked(_sizes(names), pa.uint8()), "mapq": number("mapq", pa.uint8(), 255), "bin": _checked(interval_bins(begins, begins + reaches), pa.uint16()), "n_ops": _checked(n_ops, pa.uint16()),
        "flag": number("flag", pa.uint16()), "l_seq": l_seq, "mate_ref": contig("mate_chr"), "mate_pos": number("mate_pos", pa.int32(), -1), "tlen": number("tlen", pa.int32()),
        "size": _checked(32 + _sizes(names) + 4 * n_ops + half + l_seq + sum((_sizes(t) for t in tags), np.zeros(n, np.int64)), pa.int32()),
    }
    for c, value in values.items():
        fixed[c] = value
    packed = _binary((halves[::2] << 4) | halves[1::2], half)
    parts = [_binary(fixed.view(np.uint8), np.full(n, 36)), names, _binary(ops.view(np.uint8), 4 * n_ops), packed, _binary(quality, l_seq), *tags]
    records = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()), null_handling="skip")
    return records, np.stack([np.where(pos >= 0, fixed["ref"], -1), begins, begins + reaches])


def encode_record(row: dict, numbers: dict[str, int]) -> bytes:
    """The record of one row."""
    columns = [c.split() for c in SCHEMA.split(", ")]
    kinds = {"string": pa.large_string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    return encode_records(pa.RecordBatch.from_pydict({c: pa.array([row.get(c)], kinds[t]) for c, t in columns}), numbers)[0][0].as_py()


def _checked(values: np.ndarray, kind: pa.DataType) -> np.ndarray:
    """Values of a field's size; one that it has no room for is an error."""
    return pa.array(values).cast(kind).to_numpy(zero_copy_only=False)


def _operations(cigars: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The operations of CIGARs, one CIGAR's after the other's, how many each has, and how many bases of the contig it takes (1 at
    least)."""
    data, sizes = _flat(cigars)
    of, digit = np.repeat(np.arange(len(sizes)), sizes), (data >= 48) & (data <= 57)
    at = 1 + np.flatnonzero((_OPERATION_OF[data[1:]] < 255) & digit[:-1] & (of[1:] == of[:-1]))
    begins, size, live, k = (np.cumsum(sizes) - sizes)[of[at]], np.zeros(len(at), np.int64), np.arange(len(at)), 1
    while len(live):  # one more digit of each operation that has one
        place = at[live] - k
        has = (place >= begins[live]) & digit[place]
        live, digits = live[has], data[place[has]].astype(np.int64) - 48
        if k > 9 and digits.any():
            raise ValueError("an operation is too long")
        size[live] += digits * 10 ** min(k - 1, 9)
        k += 1
    if (size >> 28).any():
        raise ValueError("an operation is too long")
    code = _OPERATION_OF[data[at]].astype(np.int64)
    return ((size << 4) | code).astype("<u4"), np.bincount(of[at], minlength=len(sizes)), _reaches(size, code, of[at], len(sizes))


def _reaches(size: np.ndarray, code: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Bases of the contig that the operations of each of n records take, 1 at least."""
    along = np.concatenate([[0], np.cumsum(np.where(code < len(_ALONG), _ALONG[np.minimum(code, len(_ALONG) - 1)], 0) * size)])
    stops = np.cumsum(np.bincount(of, minlength=n))
    return np.maximum(along[stops] - along[np.concatenate([[0], stops[:-1]])[:n]], 1)


def interval_bins(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``interval_bin`` of many."""
    out = np.zeros(len(begins), np.int64)
    for shift in range(26, 13, -3):  # the least that holds it is the last
        out = np.where(begins >> shift == (ends - 1) >> shift, ((1 << (29 - shift)) - 1) // 7 + (begins >> shift), out)
    return out


def _encoded_tag(tag: str, values: pa.Array) -> pa.LargeBinaryArray:
    """A tag with its value; null where there is none."""
    if not pa.types.is_integer(values.type):
        parts = [pa.scalar(f"{tag}Z".encode(), pa.large_binary()), values.cast(pa.large_string()).cast(pa.large_binary()), pa.scalar(b"\0", pa.large_binary())]
        return pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()))
    flat = np.zeros(len(values), [("tag", "S2"), ("kind", "S1"), ("value", "<i4")])
    flat["tag"], flat["kind"], flat["value"] = tag.encode(), b"i", pc.fill_null(values, 0).cast(pa.int32()).to_numpy(zero_copy_only=False)
    return pc.if_else(values.is_valid(), _binary(flat.view(np.uint8), np.full(len(values), 7)), None)


def _flat(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, one after the other, and how many each has."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(texts) else np.zeros(0, np.uint8), np.diff(offsets)


def _sizes(values: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _binary(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType = pa.large_binary()) -> pa.Array:
    """Bytes cut into values of the sizes given."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def plausible(data: bytes, at: int, n_refs: int) -> int:
    """Where the record that may begin there ends; 0 if none can, -1 if that can't be told."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, l_name, _, _, n_ops, _, l_seq, mate_ref, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= ref < n_refs and -1 <= mate_ref < n_refs and pos >= -1 and mate_pos >= -1 and l_name > 0 and l_seq >= 0):
        return 0
    if size < 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq:
        return 0
    end_name = at + 36 + l_name
    if end_name <= len(data) and not _NAME.fullmatch(data, at + 36, end_name):
        return 0
    return at + 4 + size


def first_record(data: bytes, n_refs: int, chain_of: int = 0) -> int:
    """Where the first record begins of data that a record may reach into: a chain of records from there uses it up, or has
    ``chain_of`` of them and then needn't. The data's size where there is none."""
    for start in range(len(data)):
        at, steps = start, 0
        while at < len(data):
            after = plausible(data, at, n_refs)
            if after == 0:
                break
            at, steps = (len(data), steps) if after == -1 else (after, steps + 1)
            if chain_of and steps == chain_of:
                return start
        else:
            if steps and not chain_of:
                return start
    return len(data)


class Records:
    """The records of a BAM file between places, which are pairs of a block's offset and an offset into its content."""

    def __init__(self, path: str):
        self.blocks = Blocks(path)
        self.names, self.head = read_header(self.blocks)

    def begin(self, offset: int) -> tuple[int, int]:
        """The place of the first record of a split that begins at an offset."""
        at = self.blocks.first_from(offset)
        if at <= self.head[0]:
            return self.head
        data, sizes, enough = b"", [], 4 * BLOCK
        for block_at, block in self.blocks.blocks(at):
            data += block
            sizes.append((block_at, len(block)))
            if len(sizes) == 1 and (place := first_record(data, len(self.names), CHAIN)) < len(data):
                return _place(sizes, place, self.blocks.size)
            if len(data) >= enough:
                place = first_record(data, len(self.names))
                if place < len(data):
                    return _place(sizes, place, self.blocks.size)
                enough *= 2  # within one record still
        return _place(sizes, first_record(data, len(self.names)), self.blocks.size)

    def stretches(self, begin: tuple[int, int], end: tuple[int, int]) -> Iterator[tuple[bytes, np.ndarray]]:
        """The records from one place up to another, those of many blocks at once: bytes, and where in them each record begins
        and the last one ends."""
        held, at, limit, size = bytearray(), begin[1], None, struct.Struct("<i").unpack_from
        for block_at, block in chain(self.blocks.blocks(begin[0]), [(self.blocks.size, b"")]) if begin < end else ():
            if limit is None and block_at >= end[0]:  # no record that begins there or behind is meant
                limit = len(held) + (end[1] if block_at == end[0] else 0)
            held += block
            if limit is None and len(held) < STRETCH:
                continue
            cuts, full = [at], len(held)
            last = full - 4 if limit is None else min(full - 4, limit - 1)
            while at <= last:
                stop = at + 4 + size(held, at)[0]
                if stop > full:
                    break
                cuts.append(stop)
                at = stop
            if len(cuts) > 1:
                yield bytes(held), np.array(cuts)
            if limit is not None and at >= limit:
                return
            if at:
                held, at, limit = held[at:], 0, None if limit is None else limit - at

    def between(self, begin: tuple[int, int], end: tuple[int, int]) -> Iterator[bytes]:
        """The bytes of each record from one place up to another."""
        for data, cuts in self.stretches(begin, end):
            yield from (data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def decode_records(raw: bytes, at: np.ndarray, ends: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """The columns that ``read_sam`` has, of the whole records that begin and end there; all records at once."""
    data, n = np.frombuffer(raw, np.uint8), len(at)
    fixed = data[at[:, None] + np.arange(36)].view(_FIXED).ravel()
    chrs = pa.array([*names, None], pa.string())

    def contig(c: str) -> pa.Array:
        return chrs.take(pa.array(np.where(fixed[c] < 0, len(names), fixed[c])))

    def text(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Texts; an empty one is told by a star."""
        made = _binary(flat, sizes, pa.large_string())
        made.validate(full=True)
        return pc.if_else(pa.array(sizes == 0), "*", made).cast(pa.string())

    flag = fixed["flag"].astype(np.int32)
    one, two = (flag & 64) != 0, (flag & 128) != 0
    seg = pa.array(np.where(one, 1, 2).astype(np.int32), mask=one == two)
    l_name, n_ops, l_seq = (fixed[c].astype(np.int64) for c in ("l_name", "n_ops", "l_seq"))
    ops_at, half = at + 36 + l_name, (l_seq + 1) // 2
    seq_at = ops_at + 4 * n_ops
    qual_at = seq_at + half
    letters = _PAIRS[_ragged(data, seq_at, half)].ravel()
    whole = np.ones(len(letters), bool)
    whole[(2 * np.cumsum(half) - 1)[l_seq % 2 == 1]] = False
    known = np.where((l_seq > 0) & (data[np.minimum(qual_at, len(data) - 1)] != 255), l_seq, 0)
    ops = _ragged(data, ops_at, 4 * n_ops).view("<u4")
    each = pc.binary_join_element_wise(pa.array(ops >> 4).cast(pa.string()), pa.array(list(OPERATIONS)).take(pa.array(ops & 15)), "")
    cigars = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_ops)]).astype(np.int32)), each), "")
    columns = {
        "read_id": _binary(_ragged(data, at + 36, l_name - 1), l_name - 1, pa.large_string()), "seg": seg, "flag": pa.array(flag), "chr": contig("ref"), "pos": pa.array(fixed["pos"].astype(np.int64)),
        "rev": pa.array((flag & 16) != 0), "mapq": pa.array(fixed["mapq"].astype(np.int32)), "cigar": pc.if_else(pa.array(n_ops == 0), "*", cigars), "mate_chr": contig("mate_ref"),
        "mate_pos": pa.array(fixed["mate_pos"].astype(np.int64)), "tlen": pa.array(fixed["tlen"].astype(np.int64)), "seq": text(letters[whole], l_seq), "qual": text(_ragged(data, qual_at, known) + np.uint8(33), known),
    }
    columns["read_id"].validate(full=True)
    columns["read_id"] = columns["read_id"].cast(pa.string())
    columns |= _tags(data, qual_at + l_seq, ends)
    assert all(len(c) == n for c in columns.values())
    return pa.RecordBatch.from_pydict(columns)


def _ragged(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of data, one after the other."""
    stops = np.cumsum(sizes)
    return data[np.repeat(starts - stops + sizes, sizes) + np.arange(stops[-1] if len(stops) else 0)]


def _numbers(data: np.ndarray, at: np.ndarray, kind: str = "<i4") -> np.ndarray:
    """The numbers that begin there."""
    return data[at[:, None] + np.arange(np.dtype(kind).itemsize)].view(kind).ravel().astype(np.int64)


_NUMBERS = {b"c": "<i1", b"C": "<u1", b"s": "<i2", b"S": "<u2", b"i": "<i4", b"I": "<u4"}
#: Bytes of a value by its kind; texts and arrays have their own.
_WIDTHS = np.zeros(256, np.int64)
for _c, _k in [*((c, np.dtype(t).itemsize) for c, t in _NUMBERS.items()), (b"f", 4), (b"A", 1)]:
    _WIDTHS[ord(_c)] = _k


def _tags(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> dict[str, pa.Array]:
    """The columns of tags; records are gone through in step, one tag of each at a time. Of tags that repeat the last counts."""
    n, zeros = len(at), np.append(np.flatnonzero(data == 0), len(data))
    places = {tag: np.full(n, -1) for tag in ALIGNMENT_TAGS}  # of the value's kind
    live = np.flatnonzero(at + 3 <= ends)
    at = at[live]
    while len(live):
        kind = data[at + 2]
        size, texts, arrays = _WIDTHS[kind], np.isin(kind, list(b"ZH")), kind == ord("B")
        size[texts] = zeros[np.searchsorted(zeros, at[texts] + 3)] - at[texts] - 2
        size[arrays] = 5 + _numbers(data, at[arrays] + 4) * _WIDTHS[data[at[arrays] + 3]]
        if (size == 0).any() or (at + 3 + size > ends[live]).any():
            raise ValueError("a tag that can't be read")
        name = data[at].astype(np.int32) << 8 | data[at + 1]
        for tag, place in places.items():
            mine = name == (ord(tag[0]) << 8 | ord(tag[1]))
            place[live[mine]] = at[mine] + 2
        at = at + 3 + size
        on = at + 3 <= ends[live]
        live, at = live[on], at[on]
    out = {}
    for tag, column in ALIGNMENT_TAGS.items():
        name, want = column.split()
        at = places[tag]
        kind = np.where(at >= 0, data[at], 0)
        values, whole = np.zeros(n, np.int64), np.isin(kind, list(b"".join(_NUMBERS)))
        for c, t in _NUMBERS.items():
            values[kind == ord(c)] = _numbers(data, at[kind == ord(c)] + 1, t)
        numbers = pa.array(values, mask=~whole)
        if want == "int":
            out[name] = numbers.cast(pa.int32())
            continue
        texts, one = np.isin(kind, list(b"ZH")), kind == ord("A")
        size = np.where(texts, zeros[np.searchsorted(zeros, at + 1)] - at - 1, one)
        made = _binary(_ragged(data, at + 1, size), size, pa.large_string())
        made.validate(full=True)
        made = pc.if_else(pa.array(texts | one), made.cast(pa.string()), None)
        out[name] = pc.if_else(pa.array(whole), numbers.cast(pa.string()), made) if whole.any() else made
    return out


# --- the source and the sink -------------------------------------------------------------------------------------------


class Bam(DataSource):
    """Alignments of a BAM file, or of a folder of them, as ``read_sam`` has them.

    Options: ``split`` (compressed bytes), and ``contig`` with ``first`` and ``last`` (places, the last excluded) for what lies
    over that stretch; files with an index beside them are then read from their first such block on.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _BamWriter(self.options)


class _BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.contig = options["path"], int(options.get("split", SPLIT)), options.get("contig", "")
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", -1))

    def partitions(self) -> list[InputPartition]:
        found = splits(self.path, ".bam" if not self.path.endswith(".bam") else "", self.split)
        if not self.contig:
            return found or [NOTHING]
        out, indexes = [], {}
        for s in found:
            if s.path not in indexes:
                system, inner = filesystem(f"{s.path}.tiles.json")
                known = system.get_file_info(inner).type == fs.FileType.File
                indexes[s.path] = json.loads(system.open_input_file(inner).read()) if known else None
            begin = s.start
            if (index := indexes[s.path]) is not None:
                tiles = index.get(self.contig, {})
                wanted = [span for t, span in tiles.items() if (int(t) + 1) * TILE > self.first and (self.last < 0 or int(t) * TILE < self.last)]
                low, high = min((a for a, _ in wanted), default=s.stop), max((b for _, b in wanted), default=-1)
                if low >= s.stop or high < s.start:
                    continue
                begin = max(s.start, low)
            out.append(Split(s.path, begin, s.stop, self.contig, self.first, self.last))
        return out or [NOTHING]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        records = Records(partition.path)
        begin, end = records.begin(partition.start), records.begin(partition.stop)
        wanted = records.names.index(partition.contig) if partition.contig in records.names else len(records.names)
        for data, cuts in records.stretches(begin, end):
            at, ends, done = cuts[:-1], cuts[1:], False
            if partition.contig:
                mine, done = self._wanted(np.frombuffer(data, np.uint8), at, wanted, partition)
                at, ends = at[mine], ends[mine]
            if len(at):
                yield decode_records(data, at, ends, records.names)
            if done:
                return

    def _wanted(self, data: np.ndarray, at: np.ndarray, wanted: int, partition: Split) -> tuple[np.ndarray, bool]:
        """Which records lie over the stretch asked for, and whether none can any more: they are in the order of contig and place."""
        ref, pos = _numbers(data, at + 4), _numbers(data, at + 8)
        past = (ref < 0) | (ref > wanted)
        if partition.last >= 0:
            past |= (ref == wanted) & (pos >= partition.last)
        done = bool(past.any())
        mine = np.flatnonzero(ref[: np.argmax(past)] == wanted) if done else np.flatnonzero(ref == wanted)
        if partition.first > 0:
            n_ops = _numbers(data, at[mine] + 16, "<u2")
            ops = _ragged(data, at[mine] + 36 + data[at[mine] + 12], 4 * n_ops).view("<u4").astype(np.int64)
            mine = mine[pos[mine] + _reaches(ops >> 4, ops & 15, np.repeat(np.arange(len(mine)), n_ops), len(mine)) > partition.first]
        return mine, done


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _BamWriter(DataSourceArrowWriter):
    """Each task writes a file of its own name; the manifest that is written at the end names those that count."""

    def __init__(self, options: dict):
        self.path, self.contigs = options["path"].rstrip("/"), json.loads(options["contigs"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, inner = filesystem(self.path)
        system.create_dir(inner, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05}-{uuid.uuid4().hex[:12]}.bam"
        numbers = {n: k for k, (n, _) in enumerate(self.contigs)}
        tiles: dict[str, dict[int, list[int]]] = {}
        with system.open_output_stream(f"{inner}/{name}", compression=None) as out:
            at = 0

            def put(data: bytes) -> None:
                nonlocal at
                for k in range(0, len(data), BLOCK):
                    at += out.write(pack_block(data[k : k + BLOCK]))

            put(encode_header(self.contigs))
            contigs = [n for n, _ in self.contigs]
            held, size, spans = [], 0, []

            def flush() -> None:
                nonlocal held, size, spans
                block = at
                put(b"".join(held))
                for ref, first, last in spans:
                    mine = tiles.setdefault(contigs[ref], {})
                    for t in range(first, last + 1):
                        mine.setdefault(t, [block, block])[1] = block
                held, size, spans = [], 0, []

            for batch in iterator:
                records, (ref, first, last) = encode_records(batch, numbers)
                data, cuts = memoryview(records.buffers()[2] or b""), np.frombuffer(records.buffers()[1], np.int64)[: batch.num_rows + 1]
                touched = np.stack([ref, first // TILE, (last - 1) // TILE])
                fresh = np.append(True, (touched[:, 1:] != touched[:, :-1]).any(axis=0))  # neighbours mostly lie in the same tiles
                k = 0
                while k < batch.num_rows:
                    stop = int(np.searchsorted(cuts, cuts[k] + BLOCK - size, side="right")) - 1
                    if stop <= k and held:
                        flush()
                        continue
                    stop = min(max(stop, k + 1), batch.num_rows)
                    held.append(data[cuts[k] : cuts[stop]])
                    size += int(cuts[stop] - cuts[k])
                    spans += [x for x in touched[:, [k, *(k + 1 + np.flatnonzero(fresh[k + 1 : stop]))]].T.tolist() if x[0] >= 0]
                    k = stop
            if held:
                flush()
            out.write(END_BLOCK)
        with system.open_output_stream(f"{inner}/{name}.tiles.json", compression=None) as out:
            out.write(json.dumps(tiles).encode())
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner = filesystem(self.path)
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner}/_manifest.json", compression=None) as out:
            out.write(json.dumps(sorted(m.name for m in messages if m)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of a job that broke off stay unnamed by any manifest."""


def register(spark: SparkSession) -> None:
    for source in (Bam, BgzfText):
        spark.dataSource.register(source)


def read_bam(spark: SparkSession, path: str, contig: str | None = None, first: int = 0, last: int = -1, split: int = SPLIT) -> DataFrame:
    """Alignments of a BAM file or folder, or those over a stretch of one contig of files in the order of places.

    Unmapped records have null ``chr``; a place that a record lacks is -1, as in the file.
    """
    register(spark)
    source = spark.read.format("bam").option("split", str(split))
    if contig is not None:
        source = source.option("contig", contig).option("first", str(first)).option("last", str(last))
    return source.load(path)


def write_bam(aln: DataFrame, contigs: list[tuple[str, int]], path: str, files: int | None = None) -> None:
    """Alignments (columns of ``read_sam``; absent ones count as null) as a folder of BAM files in the order of contig and place.

    ``contigs``: names and lengths, in the order they are to have. Rows of other contigs are unmapped and come last.
    """
    register(aln.sparkSession)
    columns = [c.split() for c in SCHEMA.split(", ")]
    given = aln.select(*[(F.col(n) if n in aln.columns else F.lit(None)).cast(t).alias(n) for n, t in columns])
    numbers = F.create_map(*[F.lit(x) for k, (n, _) in enumerate(contigs) for x in (n, k)])
    contig = F.coalesce(F.try_element_at(numbers, F.col("chr")), F.lit(len(contigs))).cast("long")
    # One number to sort by; records of one place are in no order, and are dealt to several tasks where they are many.
    ordered = given.withColumn("__at", F.shiftleft(contig, 32) + F.coalesce("pos", F.lit(-1)) + 1)
    place = ["__at", "read_id", "flag"]
    dealt = ordered.repartitionByRange(files, *place) if files else ordered.repartitionByRange(*place)
    dealt.sortWithinPartitions("__at").drop("__at").write.format("bam").option("contigs", json.dumps(contigs)).mode("append").save(path)
