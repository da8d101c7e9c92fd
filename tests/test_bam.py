"""BAM and block-compressed text: round trips, splits at every place, contigs by index, records that cross blocks."""

import gzip
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from junctura.sources import bam
from junctura.sources.bam import BLOCK, END_BLOCK, Blocks, Records, encode_header, encode_record, first_record, interval_bin, pack_block, read_bam, split_lines, write_bam
from junctura.sources.readers import read_fastq

CONTIGS = [("h0", 100_000), ("h1", 60_000), ("v0", 5_000)]


def rows(rng, n):
    out = []
    for k in range(n):
        size = rng.randint(1, 40)
        chr_, flag = rng.choice(["h0", "h0", "h1", "v0", None]), rng.choice([65, 129, 83, 163, 4, 0, 193])
        out.append({
            "read_id": f"r{k // 2}", "flag": flag, "chr": chr_, "pos": rng.randint(0, 4_900) * (10 if chr_ == "h0" else 1) if chr_ else -1, "mapq": rng.randint(0, 255), "cigar": f"{size}M" if rng.random() < 0.7 else f"3S{size}=2D1I" if chr_ else "*",
            "mate_chr": rng.choice(["h0", "v0", None]), "mate_pos": rng.randint(-1, 90), "tlen": rng.randint(-500, 500), "seq": "".join(rng.choices("ACGTN", k=size)) if rng.random() < 0.9 else "*",
            "as_score": rng.choice([None, rng.randint(-70_000, 70_000)]), "xa": rng.choice([None, "", "v0,+3,20M,1;"]), "nm": rng.choice([None, 3]),
        })
        out[-1]["qual"] = "".join(chr(rng.randint(33, 90)) for _ in range(size)) if out[-1]["seq"] != "*" and rng.random() < 0.9 else "*"
    return out


FIELDS = "read_id string, flag int, chr string, pos long, mapq int, cigar string, mate_chr string, mate_pos long, tlen long, seq string, qual string, as_score int, nm int, xa string"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def same(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


def test_round_trip_and_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bam, "BLOCK", 2_000)
    given = rows(random.Random(1), 1500)
    df = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in given], FIELDS)
    path = f"{tmp_path}/out"
    write_bam(df, CONTIGS, path, files=3)
    want = same(df)
    for split in (1 << 20, 1_700, 333):
        got = read_bam(spark, path, split=split)
        assert same(got) == want
        assert split == 1 << 20 or got.rdd.getNumPartitions() > 20
    seg = {(r["flag"], r["seg"], r["rev"]) for r in read_bam(spark, path).collect()}
    assert {(f, 1 if f & 64 and not f & 128 else 2 if f & 128 and not f & 64 else None, bool(f & 16)) for f, _, _ in seg} == seg
    for contig, _ in CONTIGS:
        assert same(read_bam(spark, path, contig=contig, split=900)) == same(df.where(F.col("chr") == contig))
    part = read_bam(spark, path, contig="h0", first=20_000, last=21_000, split=900)
    length = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[M=D]"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))
    over = df.where((F.col("chr") == "h0") & (F.col("pos") < 21_000) & (F.col("pos") + F.greatest(length, F.lit(1)) > 20_000))
    assert same(part) == same(over) and part.count()
    assert part.rdd.getNumPartitions() < read_bam(spark, path, split=900).rdd.getNumPartitions() / 3
    assert read_bam(spark, path, contig="absent").count() == 0
    order = [(r["chr"], r["pos"]) for r in read_bam(spark, path, split=1 << 30).collect()]
    keyed = [([c for c, _ in CONTIGS].index(c) if c else 9, p) for c, p in order]
    assert keyed == sorted(keyed)


def test_files_of_others(spark, tmp_path):
    """Blocks cut anywhere, records longer than several blocks, empty blocks between, unknown tags, one file."""
    rng = random.Random(2)
    numbers = {n: k for k, (n, _) in enumerate(CONTIGS)}
    given = rows(rng, 400)
    given[200] |= {"seq": "ACGTA" * 100_000, "qual": "*", "cigar": "500000M"}
    extra = b"ZAAx" + b"ZBBs" + struct.pack("<ihh", 2, 1, -1) + b"ZFf" + struct.pack("<f", 1.5)
    data = [encode_header(CONTIGS)]
    for r in given:
        record = encode_record({**dict.fromkeys(["sa", "mc", "x2", "y2"]), **r}, numbers) + extra
        data.append(struct.pack("<i", len(record) - 4) + record[4:])
    whole, blocks, at = b"".join(data), [], 0
    while at < len(whole):
        n = rng.choice([1, 50, 3_000, 60_000])
        blocks += [pack_block(whole[at : at + n]), *([END_BLOCK] if rng.random() < 0.1 else [])]
        at += n
    path = f"{tmp_path}/other.bam"
    with open(path, "wb") as f:
        f.write(b"".join([*blocks, END_BLOCK]))
    assert gzip.open(path).read() == whole
    df = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in given], FIELDS)
    want = same(df)
    for split in (1 << 30, 20_000, 2_000):
        assert same(read_bam(spark, path, split=split)) == want


def test_no_split_loses_or_repeats_a_record(tmp_path):
    rng = random.Random(3)
    numbers = {n: k for k, (n, _) in enumerate(CONTIGS)}
    records = [encode_record({**dict.fromkeys(["sa", "mc", "x2", "y2"]), **r}, numbers) for r in rows(rng, 60)]
    whole = encode_header(CONTIGS) + b"".join(records)
    path = f"{tmp_path}/x.bam"
    with open(path, "wb") as f:
        f.write(b"".join(pack_block(whole[k : k + 700]) for k in range(0, len(whole), 700)) + END_BLOCK)
    found = Records(path)
    for size in (1, 97, 400, 5_000):
        cuts = [found.begin(k) for k in range(0, found.blocks.size + size, size)]
        assert cuts == sorted(cuts)
        assert [r for a, b in zip(cuts[:-1], cuts[1:], strict=True) for r in found.between(a, b)] == records
    assert first_record(b"", 3) == 0 and first_record(b"no record here" * 9, 3) == 126


def test_format_values():
    assert gzip.decompress(pack_block(b"abc") + END_BLOCK) == b"abc" and len(END_BLOCK) == 28
    assert [interval_bin(0, 1), interval_bin(1 << 14, (1 << 14) + 9), interval_bin(0, 1 << 15), interval_bin(0, 1 << 28)] == [4681, 4682, 585, 0]
    assert BLOCK < 1 << 16


def test_not_bam(tmp_path):
    path = f"{tmp_path}/x"
    with open(path, "wb") as f:
        f.write(pack_block(b"something else") + END_BLOCK)
    with pytest.raises(ValueError, match="BAM"):
        Records(path)


def test_lines_of_all_splits(tmp_path):
    rng = random.Random(4)
    for k in range(20):
        text = b"".join(b"x" * rng.choice([0, 1, 30, 900]) + b"\n" for _ in range(rng.randint(0, 60))) + (b"end" if k % 2 else b"")
        path, at, blocks = f"{tmp_path}/t{k}.gz", 0, []
        while at < len(text):
            n = rng.choice([1, 10, 200])
            blocks.append(pack_block(text[at : at + n]))
            at += n
        with open(path, "wb") as f:
            f.write(b"".join(blocks) + END_BLOCK)
        size = Blocks(path).size
        want = text.split(b"\n") if not text.endswith(b"\n") and text else text.split(b"\n")[:-1]
        for split in (1, 60, 400, size):
            got = [line for a in range(0, size, split) for line in split_lines(path, a, a + split)]
            assert got == want


def test_block_compressed_fastq(spark, tmp_path):
    reads = [(f"r{k}", "ACGT" * (k % 9 + 1), "IIII" * (k % 9 + 1)) for k in range(700)]
    text = "".join(f"@{n} more\n{s}\n+\n{q}\n" for n, s, q in reads).encode()
    path = f"{tmp_path}/reads.fastq.gz"
    with open(path, "wb") as f:
        f.write(b"".join(pack_block(text[k : k + 777]) for k in range(0, len(text), 777)) + END_BLOCK)
    from junctura.sources.bam import register

    register(spark)
    assert spark.read.format("bgzf_text").option("split", "500").load(path).rdd.getNumPartitions() > 5
    got = sorted((r["ord"], r["read_id"], r["seq"], r["qual"]) for r in read_fastq(spark, path, blocked=True).collect())
    assert [x[1:] for x in got] == reads and [x[0] for x in got] == list(range(700))


def test_records_of_many_rows_are_those_of_the_format(tmp_path):
    """All rows of a batch at once, against the format's definition, odd values among them; and back."""
    numbers = {n: k for k, (n, _) in enumerate(CONTIGS)}
    given = [{**dict.fromkeys(["seg", "rev", "sa", "mc", "x2", "y2"]), **r} for r in rows(random.Random(5), 300)]
    given[7] |= {"cigar": "268435455M", "seq": "acgtn", "qual": "!~5I"}
    given[8] |= {"cigar": "007M00012N", "seq": "A", "qual": "*", "read_id": None, "pos": None, "mapq": None, "mate_pos": None, "x2": -5}
    given[9] |= {"seq": "Ä?C", "qual": None, "xa": "ü", "mc": ""}
    want, ends = [], []
    for r in given:
        seq, qual = ("" if r["seq"] == "*" else r["seq"]), r["qual"] or "*"
        ops = [(int(n) << 4) | bam.OPERATIONS.index(c) for n, c in re.findall(r"(\d+)([A-Z=])", r["cigar"])]
        pos, name = -1 if r["pos"] is None else r["pos"], (r["read_id"] or "*").encode() + b"\0"
        end = max(pos, 0) + (sum(x >> 4 for x in ops if bam.OPERATIONS[x & 15] in "MDN=X") or 1)
        body = struct.pack(
            "<iiBBHHHiiii", numbers.get(r["chr"], -1), pos, len(name), 255 if r["mapq"] is None else r["mapq"], interval_bin(max(pos, 0), end), len(ops), r["flag"],
            len(seq), numbers.get(r["mate_chr"], -1), -1 if r["mate_pos"] is None else r["mate_pos"], r["tlen"],
        )
        letters = [max(bam.BASES.find(c.upper()), 0) or 15 for c in seq] + [0]
        body += name + struct.pack(f"<{len(ops)}I", *ops) + bytes(letters[k] << 4 | letters[k + 1] for k in range(0, len(seq), 2))
        body += bytes(ord(c) - 33 for c in qual) if qual != "*" and len(qual) == len(seq) else b"\xff" * len(seq)
        for tag, column in bam.ALIGNMENT_TAGS.items():
            if (value := r.get(column.split()[0])) is not None:
                body += tag.encode() + (b"i" + struct.pack("<i", value) if column.endswith("int") else b"Z" + value.encode() + b"\0")
        want.append(struct.pack("<i", len(body)) + body)
        ends.append(end)
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    batch = pa.RecordBatch.from_pydict({c: pa.array([r.get(c) for r in given], kinds[t]) for c, t in (x.split() for x in bam.SCHEMA.split(", "))})
    records, (_, _, last) = bam.encode_records(batch, numbers)
    assert records.to_pylist() == want and last.tolist() == ends
    assert bam.encode_records(batch.slice(5, 9), numbers)[0].to_pylist() == want[5:14]
    cuts = np.cumsum([0, *map(len, want)])
    back = bam.decode_records(b"".join(want), cuts[:-1], cuts[1:], [n for n, _ in CONTIGS]).to_pylist()
    assert [(r["pos"], r["mapq"], r["tlen"], r["xa"], r["as_score"]) for r in back[:7]] == [(r["pos"], r["mapq"], r["tlen"], r["xa"], r["as_score"]) for r in given[:7]]
    assert (back[8]["read_id"], back[8]["cigar"], back[8]["qual"], back[8]["x2"], back[9]["seq"], back[9]["mc"]) == ("*", "7M12N", "*", -5, "NNC", "")
    for odd in ({"cigar": "268435456M"}, {"pos": 1 << 31}, {"read_id": "r" * 255}, {"seq": "AC", "qual": " I"}):
        with pytest.raises(ValueError):
            encode_record({**given[0], **odd}, numbers)


def test_a_split_reads_little_beyond_itself(tmp_path):
    rng, numbers = random.Random(6), {n: k for k, (n, _) in enumerate(CONTIGS)}
    whole = encode_header(CONTIGS) + b"".join(encode_record(r, numbers) for r in rows(rng, 2_000)) * 60
    path = f"{tmp_path}/x.bam"
    with open(path, "wb") as f:
        f.write(b"".join(pack_block(whole[k : k + BLOCK]) for k in range(0, len(whole), BLOCK)) + END_BLOCK)

    class Counted:
        def __init__(self, file):
            self.file, self.bytes = file, 0

        def read_at(self, n, at):
            self.bytes += n
            return self.file.read_at(n, at)

    found = Records(path)
    assert found.blocks.size > 4 << 20
    counted = found.blocks.file = Counted(found.blocks.file)
    bam.read_header(found.blocks)
    assert list(found.between(found.begin(500_000), found.begin(600_000)))
    assert counted.bytes < 2_000_000
