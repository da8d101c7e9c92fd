"""Readers and sinks, and screening on a stream."""

import gzip
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from junctura.config import JunctionConfig
from junctura.sources import readers, shared, writers
from junctura.streaming.screening import screen_stream


def test_fastq(spark, tmp_path):
    def fastq(n, seg):
        return "".join(f"@r{i}\nAC{'GT'[seg - 1]}{i}\n+\nII{i}\n" for i in range(n))

    (tmp_path / "a.fq").write_text(fastq(5, 1))
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(fastq(4, 2) + "@unfinished\nAC\n")
    pairs = readers.read_fastq_pairs(spark, f"file://{tmp_path}/a.fq", f"file://{tmp_path}/b.fq.gz")
    got = sorted((r.read_id, r.seg, r.seq) for r in pairs.collect())
    assert got == sorted((f"r{i}", s, f"AC{'GT'[s - 1]}{i}") for i in range(4) for s in (1, 2))
    assert readers.sample_pairs(pairs, 2).count() == 4
    writers.write_fastq(pairs, f"file://{tmp_path}/out", 2)
    assert sorted(r.read_id for r in readers.read_fastq(spark, f"file://{tmp_path}/out/*.txt").collect())[:1] == ["r0"]


@pytest.mark.parametrize("split", ["37b", "128m"])
def test_fastq_moves_no_whole_record(spark, tmp_path, split):
    rng = random.Random(3)
    want, files = [], {}
    for name in ("a", "b", "c"):
        rows = [(f"{name}{i}", "".join(rng.choices("ACGT", k=rng.randint(0, 40))), "".join(rng.choices("@+I#", k=rng.randint(0, 40)))) for i in range(rng.randint(1, 12))]
        want += rows
        files[name] = "".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in rows) + "@unfinished\nAC\n" * (name == "b")
        (tmp_path / f"{name}.fq").write_text(files[name])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(before, (split, "1b", "3"), strict=True):
            spark.conf.set(k, v)
        frame = readers.read_fastq(spark, f"file://{tmp_path}/*.fq")
        assert sorted(tuple(r) for r in frame.collect()) == [(i, *r) for i, r in enumerate(want)]
        pieces = readers._records(spark, f"file://{tmp_path}/*.fq", False)
        assert not any("SortMergeJoin" in x._jdf.queryExecution().toString() for x in (frame, pieces))  # lines are not dealt by block
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_fasta_and_catalog(spark, tmp_path):
    (tmp_path / "h.fa").write_text(">c1 first\nacgt\nAC\n>c2\nGG\n")
    (tmp_path / "v.fa").write_text(">v1\nTTT\n")
    h, v = (f"file://{tmp_path}/{n}.fa" for n in "hv")
    assert sorted((r.chr, r.seq, r.len) for r in readers.read_fasta(spark, h).collect()) == [("c1", "ACGTAC", 6), ("c2", "GG", 2)]
    assert [(r.chr, r.contig_id, r.is_virus) for r in readers.contig_catalog(spark, h, v).orderBy("contig_id").collect()] == [("c1", 1, False), ("c2", 2, False), ("v1", 3, True)]


@pytest.mark.parametrize("split", ["61b", "128m"])
def test_fasta_chunks_by_lines(spark, tmp_path, split):
    rng = random.Random(5)
    lines, want = ["ACGT"], {}
    for k in range(40):
        name = rng.choice([f"c{k} more words", f"c{k}", f"c{k}\tx>y"]) if k != 7 else ""
        lines.append(f">{name}")
        parts = ["".join(rng.choice("ACGTacgtn") for _ in range(rng.choice([0, 1, 7, 10, 33, 150]))) for _ in range(rng.choice([0, 1, 2, 9]))]
        lines += [p + rng.choice(["", " ", "\r"]) for p in parts]
        if name:
            want[f"c{k}"] = "".join(parts).upper()
    (tmp_path / "a.fa").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.fa").write_text(">c1\nGG\n>\nCC\n>e")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted(tuple(r) for r in readers.read_fasta_chunks(spark, f"file://{tmp_path}/*.fa", 10).select("chr", "chunk", "part").collect())
        catalogue = {r.chr: r.len for r in readers.contig_catalog(spark, f"file://{tmp_path}/a.fa", f"file://{tmp_path}/b.fa").where("NOT is_virus").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    every = [*want.items(), ("c1", "GG"), ("e", "")]
    assert got == sorted((c, i // 10, s[i : i + 10]) for c, s in every for i in range(0, max(len(s), 1), 10))
    assert catalogue == {c: len(s) for c, s in want.items()}


def test_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tx\nr1\t65\tc1\t11\t60\t5M\t=\t31\t25\tACGTA\tIIIII\tAS:i:5\tXA:Z:c2,-3,5M,0;\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    one, two = readers.read_sam(spark, f"file://{tmp_path}/x.sam").orderBy("read_id").collect()
    assert (one.seg, one.chr, one.pos, one.mate_chr, one.mate_pos, one.as_score, one.xa, one.nm) == (1, "c1", 10, "c1", 30, 5, "c2,-3,5M,0;", None)
    assert (two.seg, two.chr) == (None, None)


def test_bed_calls_edges(spark, tmp_path):
    (tmp_path / "x.bed").write_text("# c\nc1\t5\t9\tn\t.\t-\nc1 7 8\n")
    assert [(r.start, r.end, r.strand) for r in readers.read_bed(spark, f"file://{tmp_path}/x.bed").orderBy("start").collect()] == [(5, 9, "-"), (7, 8, None)]
    (tmp_path / "calls").write_text("3 c1:-:5:9 v:+:1:2 7 7 2 90 0.900000 0.800000 0 0 0.500000 0.250000\n")
    c = readers.read_calls(spark, f"file://{tmp_path}/calls").first()
    assert (c.call_id, c.host_rev, c.host_start, c.virus_end, c.split_reads, c.virus_cov) == (3, True, 5, 2, 2, 0.25)
    (tmp_path / "edges").write_text("c1,5,9,+:v,1,2,-\tr1,r2,\t2\n")
    assert [(r.h_left, r.v_strand, r.frag_id) for r in readers.read_edges(spark, f"file://{tmp_path}/edges").orderBy("frag_id").collect()] == [(5, "-", "r1"), (5, "-", "r2")]
    (tmp_path / "er.fa").write_text(">a_H\nAC\n>a_V\nGG\n>b_1\nTT\n>b_2\nCC\n>c_1\nAA\n>d_H\nA\n")
    got = {(r.frag_id, r.is_split, r.mate_frag_id) for r in readers.read_edge_reads(spark, f"file://{tmp_path}/er.fa").collect()}
    assert got == {("a", False, None), ("b_1", True, "b_2"), ("b_2", True, "b_1"), ("c_1", True, None)}
    (tmp_path / "kv").write_text("max_is 500\nread_len 150\n")
    assert readers.read_settings(spark, f"file://{tmp_path}/kv") == {"max_is": "500", "read_len": "150"}


def test_stage_is_made_once(spark, tmp_path):
    path, calls = f"file://{tmp_path}/stage", []

    def make():
        calls.append(1)
        return spark.range(3)

    assert shared.stage(spark, path, make).count() == 3 == shared.stage(spark, path, make).count()
    assert len(calls) == 1


def test_stream(spark, tmp_path):
    rng = random.Random(1)
    ref = "".join(rng.choices("ACGT", k=80))
    rows = [("hit", 1, ref[5:60], "I", 0), ("hit", 2, "T" * 20, "I", 0), ("miss", 1, "A" * 40, "I", 1), ("miss", 2, None, "I", 1)]
    spark.createDataFrame(rows, "read_id string, seg int, seq string, qual string, ord long").write.parquet(f"file://{tmp_path}/in")
    refs = spark.createDataFrame([(ref,)], "seq string")
    query = screen_stream(spark, f"file://{tmp_path}/in", refs, f"file://{tmp_path}/out", f"file://{tmp_path}/ck", JunctionConfig())
    query.awaitTermination(60)
    assert {r.read_id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {"hit"}


def test_a_contig_with_few_places_is_many_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(4000).select(F.col("id").alias("read_id"), F.lit("h0").alias("chr"), (F.col("id") % 2 * 25).alias("pos"))
    writers.write_by_contig(rows, str(tmp_path / "by-contig"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "by-contig")).where("chr = 'h0'")
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 3 and max(sizes) < 2000
    assert back.select("read_id").distinct().count() == 4000


@pytest.mark.parametrize("size", [1, 3, 100])
def test_fasta_pieces_leave_only_what_blocks_part(size):
    """Whole chunks are made where lines are read, whatever batches they come in; only ends of blocks are left."""
    lines = [("a", 0, 0, "ACGTA", None), ("a", 0, 1, "CC", None), ("a", 0, 2, "", "x"), ("a", 0, 3, "", "y"), ("a", 0, 4, "ACGTACGT", None), ("a", 0, 5, "", "z"), ("a", 0, 6, "ACGT", None), ("a", 9, 7, "", "w"), ("b", 0, 8, "", "v"), ("b", 0, 9, "GGG", None), ("b", 5, 10, "TTTTT", None)]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), types, strict=True)], names=["file", "block", "id", "letters", "chr"])
    got = [tuple(r.values()) for b in readers._pieces((whole.slice(k, size) for k in range(0, len(lines), size)), 4) for r in b.to_pylist()]
    assert got == [
        ("a", 0, None, None, False, 0, "ACGT"), ("a", 0, None, None, False, 4, "ACC"), ("a", 0, 2, "x", True, 0, ""), ("a", 0, 3, "y", True, 0, "ACGT"), ("a", 0, 3, "y", True, 4, "ACGT"), ("a", 0, 5, "z", True, 0, "ACGT"),
        ("a", 0, 5, "z", False, 4, ""), ("a", 9, 7, "w", False, 0, ""), ("b", 0, 8, "v", False, 0, "GGG"), ("b", 5, None, None, False, 0, "TTTT"), ("b", 5, None, None, False, 4, "T"),
    ]
