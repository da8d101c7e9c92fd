"""Readers of the domain's text formats, as DataFrames. Positions become 0-based and half-open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.operators.windows import CHUNK

ALIGNMENT_TAGS = {"AS": "as_score int", "NM": "nm int", "XA": "xa string", "SA": "sa string", "MC": "mc string", "X2": "x2 int", "Y2": "y2 int"}


def _lines(spark: SparkSession, path: str, blocked: bool) -> DataFrame:
    """``file, block, id, value``: lines in the order of block and id."""
    if blocked:
        from junctura.sources.bam import register

        register(spark)
        return spark.read.format("bgzf_text").load(path).withColumnRenamed("at", "id")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("id"), "value")


def numbered_lines(spark: SparkSession, path: str, blocked: bool = False) -> DataFrame:
    """``file, line_no, value``: lines with their number in the file, gzip included.

    Lines are numbered within the blocks that Spark reads a file in, and blocks are laid end to end by the sizes of those
    before them, so one large file is many tasks. A compressed file is one block, but for one that is compressed block by
    block (BGZF), if ``blocked`` says so.
    """
    return _numbered(spark, path, blocked).select("file", "line_no", "value")


def _numbered(spark: SparkSession, path: str, blocked: bool) -> DataFrame:
    """``file, block, line_no, value``. Ids of a block's lines follow each other, so a line's number is told by the block's
    first; one row a block is shipped and no line is moved."""
    lines = _lines(spark, path, blocked)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    sizes = sizes.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("past"))
    return lines.join(F.broadcast(sizes), ["file", "block"]).select("file", "block", (F.col("past") + F.col("id") - F.col("first")).alias("line_no"), "value")


def _records(spark: SparkSession, path: str, blocked: bool) -> DataFrame:
    """``file, ord, name, seq, qual``: four lines a row. Lines of a record follow each other in a task but for those that a
    block's end parts; only these meet by a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            yield from _assembled(rows, False)
            held = rows.slice(_whole(rows))
        if held is not None:
            yield from _assembled(held, True)

    # The same lines for both, whole records and parts of such.
    pieces = _numbered(spark, path, blocked).mapInArrow(run, "file string, ord long, whole boolean, name string, seq string, qual string")
    parts = pieces.where("NOT whole").groupBy("file", "ord").agg(*[F.max(c).alias(c) for c in ("name", "seq", "qual")])
    return pieces.where("whole").drop("whole").unionByName(parts).where("name IS NOT NULL AND qual IS NOT NULL")


def _whole(rows: pa.Table) -> int:
    """How many rows there are ahead of the last record, which the next batch may go on with."""
    n, number = rows.num_rows, rows.column("line_no").to_numpy()
    if not n:
        return 0
    file, block = (rows.column(c) for c in ("file", "block"))
    same = pc.and_(pc.equal(file, file[n - 1]), pc.equal(block, block[n - 1])).to_numpy()
    last = same & (number // 4 == number[-1] // 4) & (np.arange(n) >= n - 4)
    return n if last.sum() == 4 else n - int(last.sum())


def _assembled(rows: pa.Table, all_: bool) -> Iterator[pa.RecordBatch]:
    rows = rows if all_ else rows.slice(0, _whole(rows))
    n = rows.num_rows
    if not n:
        return
    number = rows.column("line_no").to_numpy()
    block = rows.column("block").to_numpy()
    file = pc.dictionary_encode(rows.column("file").combine_chunks()).indices.to_numpy()
    opens = np.append(True, (number[1:] // 4 != number[:-1] // 4) | (block[1:] != block[:-1]) | (file[1:] != file[:-1]))
    first = np.flatnonzero(opens)
    of = np.cumsum(opens) - 1
    value = rows.column("value").combine_chunks()
    columns = {"file": rows.column("file").take(pa.array(first)), "ord": pa.array(number[first] // 4), "whole": pa.array(np.bincount(of) == 4)}
    for k, c in ((0, "name"), (1, "seq"), (3, "qual")):
        at = np.full(len(first), -1)
        mine = np.flatnonzero(number % 4 == k)
        at[of[mine]] = mine
        columns[c] = value.take(pa.array(at, mask=at < 0))
    yield from pa.table(columns).to_batches()


def read_fastq(spark: SparkSession, path: str, blocked: bool = False) -> DataFrame:
    """``ord, read_id, seq, qual``: records of four lines; an unfinished last record is left out. ``blocked``: BGZF.

    ``path`` may be a folder of part files, which are taken in the order of their names; none splits a record.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # files, not records
    # A record is whole where its fourth line is.
    sizes = _lines(spark, path, blocked).groupBy("file").agg(F.floor(F.count("*") / 4).alias("n"))
    past = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("past"))
    name = F.regexp_extract("name", r"^@(\S+)", 1)
    return _records(spark, path, blocked).join(F.broadcast(past), "file").select((F.col("past") + F.col("ord")).alias("ord"), name.alias("read_id"), "seq", "qual")


def read_fastq_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """``read_id, seg, seq, qual, ord``: two files in lock-step, as far as the shorter goes."""
    if first == second:
        raise ValueError("the two files are the same")
    a, b = (read_fastq(spark, p) for p in (first, second))
    both = a.select("ord", F.struct("read_id", "seq", "qual").alias("a")).join(b.select("ord", F.struct("seq", "qual").alias("b")), "ord")
    mates = F.array(F.struct(F.lit(1).alias("seg"), F.col("a.seq").alias("seq"), F.col("a.qual").alias("qual")), F.struct(F.lit(2).alias("seg"), F.col("b.seq").alias("seq"), F.col("b.qual").alias("qual")))
    return both.select("ord", F.col("a.read_id").alias("read_id"), F.explode(mates).alias("m")).select("read_id", "m.seg", "m.seq", "m.qual", "ord")


def sample_pairs(reads: DataFrame, n: int = 100_000) -> DataFrame:
    """The first ``n`` pairs of a file, in its order."""
    return reads.where(F.col("ord") < n)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``chr, seq, len``: upper-case sequences by the first word of their header."""
    blocks = spark.read.option("lineSep", ">").text(path).where("value <> ''")
    name = F.regexp_extract("value", r"^(\S+)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", ""))
    return blocks.select(name.alias("chr"), seq.alias("seq")).where("chr <> ''").withColumn("len", F.length("seq").cast("long"))


def read_fasta_chunks(spark: SparkSession, path: str, width: int = CHUNK, blocked: bool = False) -> DataFrame:
    """``chr, chunk, part``: contigs cut into rows of ``width`` upper-case bases as ``contig_chunks`` has them, but put together
    from lines, so that no row ever holds a contig and one large file is many tasks.

    A header is a line that begins with ``>``; its first word names the contig, and one without a name goes with its bases, as
    do bases ahead of any header. Blank lines count nothing, a contig without bases is one empty chunk 0, and contigs that
    share a name stay apart, each with its own chunks. A line is a row, so lines have to stay below 2 GB. ``blocked``: BGZF.

    A block's lines follow each other in a task, which hands on the chunks that lie within the block and holds one at a time. Only
    what a block's ends part is moved: the contig and the bases that a block finds open at its start are carried over one row a
    block. For these the files are read once more, which takes less than to keep lines.
    """
    lines = _lines(spark, path, blocked).withColumn("is_head", F.col("value").startswith(">"))
    letters = F.when(F.col("is_head"), "").otherwise(F.upper(F.regexp_replace("value", r"\s+", "")))
    chr_ = F.when(F.col("is_head"), F.regexp_extract("value", r"^>(\S*)", 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pieces(batches, width)

    pieces = lines.select("file", "block", "id", letters.alias("letters"), chr_.alias("chr")).mapInArrow(run, "file string, block long, id long, chr string, whole boolean, at long, part string")
    whole = pieces.where("whole AND chr <> ''").select("chr", F.floor(F.col("at") / width).alias("chunk"), "part")

    open_ = pieces.where("NOT whole").withColumn("n", F.length("part").cast("long")).withColumn("head", F.when(F.col("id").isNotNull(), F.struct("block", "id", "chr")))
    over = Window.partitionBy("file").orderBy("block")
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("n")
    ends = open_.groupBy("file", "block").agg(F.max("head").alias("last"), F.coalesce(F.max(F.when(F.col("id").isNotNull(), end)), F.max(end)).alias("tail"))
    ends = ends.withColumn("sum", F.coalesce(F.sum("tail").over(past), F.lit(0)))
    opened = F.coalesce(F.max(F.when(F.col("last").isNotNull(), F.col("sum"))).over(past), F.lit(0))
    ends = ends.select("file", "block", F.last("last", ignorenulls=True).over(past).alias("open"), (F.col("sum") - opened).alias("carried"))

    at = F.when(F.col("head").isNull(), F.col("at") + F.col("carried")).otherwise(F.col("at"))
    placed = open_.join(F.broadcast(ends), ["file", "block"]).select("file", F.coalesce("head", "open").alias("head"), at.alias("at"), "n", "part")
    placed = placed.where("head.chr <> '' AND (n > 0 OR at = 0)")
    touched = F.sequence(F.floor(F.col("at") / width), F.floor(F.greatest(F.col("at") + F.col("n") - 1, F.col("at")) / width))
    cut = placed.withColumn("chunk", F.explode(touched)).withColumn("from", F.greatest(F.col("at"), F.col("chunk") * width))
    size = F.least(F.col("at") + F.col("n"), (F.col("chunk") + 1) * width) - F.col("from")
    piece = F.substring("part", (F.col("from") - F.col("at") + 1).cast("int"), size.cast("int"))
    parts = cut.select("file", "head", "chunk", F.struct("from", piece.alias("p")).alias("piece")).groupBy("file", "head", "chunk").agg(F.sort_array(F.collect_list("piece")).alias("ps"))
    return whole.unionByName(parts.select(F.col("head.chr").alias("chr"), "chunk", F.array_join(F.transform("ps", lambda x: x["p"]), "").alias("part")))


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """``file, block, id, chr, whole, at, part``: whole chunks of contigs (``id``: the header's line), and what isn't known to be
    one: what a block's last contig has behind its last whole chunk, be it nothing, and the bases ahead of a block's first header
    (null ``id``, places within the block) in pieces of at most ``width``."""
    key, contig, at, held, made = None, (None, None), 0, "", []

    def hand(texts: list[str], whole: bool) -> None:
        nonlocal at
        for text in texts:
            made.append((*key, *contig, whole, at, text))
            at += len(text)

    def close(by_header: bool) -> None:
        """The contig ends with another's header or goes on in the next block."""
        if key is not None and (held or (contig[0] is not None and (at == 0 or not by_header))):
            hand([held], by_header and contig[0] is not None)

    def batch() -> pa.RecordBatch:
        names = ["file", "block", "id", "chr", "whole", "at", "part"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    for rows in batches:
        n = rows.num_rows
        if not n:
            continue
        block, is_head = rows.column("block").to_numpy(), rows.column("chr").is_valid().to_numpy(zero_copy_only=False)
        file = pc.dictionary_encode(rows.column("file")).indices.to_numpy()
        opens = np.append(True, (block[1:] != block[:-1]) | (file[1:] != file[:-1]))
        starts = np.flatnonzero(opens | is_head)
        letters = rows.column("letters").cast(pa.large_string())
        offsets = np.frombuffer(letters.buffers()[1], np.int64)[letters.offset : letters.offset + n + 1]
        data = memoryview(letters.buffers()[2] or b"")
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
            if opens[a] and (now := (rows.column("file")[a].as_py(), int(block[a]))) != key:
                close(False)
                key, contig, at, held = now, (None, None), 0, ""
            if is_head[a]:
                close(True)
                contig, at, held = (rows.column("id")[a].as_py(), rows.column("chr")[a].as_py()), 0, ""
            held += str(data[offsets[a] : offsets[b]], "utf-8")
            last = len(held) - len(held) % width
            hand([held[k : k + width] for k in range(0, last, width)], contig[0] is not None)
            held = held[last:]
        if made:
            yield batch()
            made.clear()
    close(False)
    if made:
        yield batch()


def contig_catalog(spark: SparkSession, host: str, virus: str) -> DataFrame:
    """``chr, contig_id, len, is_virus``: both references' contigs, numbered from 1 in the order of organism and name.

    Lengths are sums over chunks, so contigs may have any; those of one organism that share a name count as one.
    """
    chunks = [read_fasta_chunks(spark, path).withColumn("is_virus", F.lit(v)) for path, v in ((host, False), (virus, True))]
    both = chunks[0].unionByName(chunks[1]).groupBy("chr", "is_virus").agg(F.sum(F.length("part")).alias("len"))
    return both.select("chr", F.row_number().over(Window.orderBy("is_virus", "chr")).alias("contig_id"), "len", "is_virus")


def _tag(name: str, kind: str) -> Column:
    value = F.regexp_extract("rest", rf"(?:^|\t){name}:\w:([^\t]*)", 1)
    found = F.when(F.col("rest").rlike(rf"(^|\t){name}:"), value)
    return found.try_cast("int") if kind == "int" else found


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a SAM text file: the fixed columns, ``seg`` (null unless one segment bit is set), ``rev``, tags."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@"))
    f = F.split("value", "\t", 12)
    flag = f[1].cast("int")
    first, second = flag.bitwiseAND(64) != 0, flag.bitwiseAND(128) != 0
    base = lines.select(
        f[0].alias("read_id"), F.when(first & ~second, 1).when(second & ~first, 2).alias("seg"), flag.alias("flag"), F.nullif(f[2], F.lit("*")).alias("chr"),
        (f[3].cast("long") - 1).alias("pos"), (flag.bitwiseAND(16) != 0).alias("rev"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"),
        F.when(f[6] == "=", f[2]).otherwise(F.nullif(f[6], F.lit("*"))).alias("mate_chr"), (f[7].cast("long") - 1).alias("mate_pos"), f[8].cast("long").alias("tlen"), f[9].alias("seq"), f[10].alias("qual"),
        F.coalesce(F.try_element_at(f, F.lit(12)), F.lit("")).alias("rest"),
    )
    tags = [_tag(name, spec.split()[1]).alias(spec.split()[0]) for name, spec in ALIGNMENT_TAGS.items()]
    return base.select("*", *tags).drop("rest")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """``chr, start, end, name, score, strand``; columns that a line lacks are null."""
    f = F.split(F.trim("value"), r"\s+")

    def field(k: int) -> Column:
        return F.try_element_at(f, F.lit(k))

    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#') AND NOT startswith(value, 'track')")
    return lines.select(field(1).alias("chr"), field(2).cast("long").alias("start"), field(3).cast("long").alias("end"), field(4).alias("name"), field(5).alias("score"), field(6).alias("strand")).where("start >= 0")


def read_region_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="frag_id string, region_id string")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``h_*, v_*, frag_id``: one row for each fragment of an edge line ``host:virus <tab> frag,frag <tab> n``."""
    rows = spark.read.csv(path, sep="\t", schema="regions string, frags string, n int")
    sides = [F.split(F.split("regions", ":")[k], ",") for k in (0, 1)]
    cols = [c for s, x in zip("hv", sides, strict=True) for c in (x[0].alias(f"{s}_chr"), x[1].cast("long").alias(f"{s}_left"), x[2].cast("long").alias(f"{s}_right"), x[3].alias(f"{s}_strand"))]
    return rows.select(*cols, F.explode(F.filter(F.split("frags", ","), lambda x: x != "")).alias("frag_id"))


def read_region_sequences(spark: SparkSession, path: str) -> DataFrame:
    """``region, chr, left, right, strand, seq`` from headers ``region::chr:start-end(strand)``."""
    fasta = read_fasta(spark, path)
    parts = [F.regexp_extract("chr", r"^(.*)::(.*):(\d+)-(\d+)\((.)\)$", k) for k in range(1, 6)]
    return fasta.select(parts[0].alias("region"), parts[1].alias("chr"), parts[2].cast("long").alias("left"), parts[3].cast("long").alias("right"), parts[4].alias("strand"), "seq")


def read_edge_reads(spark: SparkSession, path: str) -> DataFrame:
    """``frag_id, is_split, host_seq, virus_seq, mate_frag_id``: pairs from ``_H``/``_V``, split mates from ``_1``/``_2``."""
    fasta = read_fasta(spark, path)
    named = fasta.select(F.regexp_extract("chr", r"^(.*)_([HV12])$", 1).alias("name"), F.regexp_extract("chr", r"^(.*)_([HV12])$", 2).alias("end"), "seq")
    pairs = named.where("end IN ('H', 'V')").groupBy("name").agg(F.max(F.when(F.col("end") == "H", F.col("seq"))).alias("host_seq"), F.max(F.when(F.col("end") == "V", F.col("seq"))).alias("virus_seq"))
    pairs = pairs.where("host_seq IS NOT NULL AND virus_seq IS NOT NULL").select(F.col("name").alias("frag_id"), F.lit(False).alias("is_split"), "host_seq", "virus_seq", F.lit(None).cast("string").alias("mate_frag_id"))
    ends = F.array_distinct(F.collect_list("end").over(Window.partitionBy("name")))  # two at most
    split = named.where("end IN ('1', '2')").withColumn("ends", ends)
    mate = F.when(F.size("ends") == 2, F.concat("name", F.lit("_"), F.when(F.col("end") == "1", "2").otherwise("1")))
    split = split.select(F.concat_ws("_", "name", "end").alias("frag_id"), F.lit(True).alias("is_split"), F.col("seq").alias("host_seq"), F.col("seq").alias("virus_seq"), mate.alias("mate_frag_id"))
    return pairs.unionByName(split)


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """``call_id, side, start, end`` of masked spans named ``id_L`` or ``id_R``."""
    bed = read_bed(spark, path)
    return bed.select(F.regexp_extract("chr", r"^(\d+)_([LR])$", 1).cast("long").alias("call_id"), F.regexp_extract("chr", r"^(\d+)_([LR])$", 2).alias("side"), "start", "end")


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Calls of 13 fields."""
    f = F.split("value", r"\s+")
    places = []
    for s, k in (("host", 1), ("virus", 2)):
        p = F.split(f[k], ":")
        places += [p[0].alias(f"{s}_chr"), (p[1] == "-").alias(f"{s}_rev"), p[2].cast("long").alias(f"{s}_start"), p[3].cast("long").alias(f"{s}_end")]
    names = ["reads int", "good_pairs int", "split_reads int", "score int", "host_pbs double", "virus_pbs double", "reads_w_dups int", "unique_reads_w_dups int", "host_cov double", "virus_cov double"]
    return spark.read.text(path).where("trim(value) <> ''").select(f[0].cast("long").alias("call_id"), *places, *[f[k + 3].cast(n.split()[1]).alias(n.split()[0]) for k, n in enumerate(names)])


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """Lines ``key value`` of a settings file, which the driver holds; of several lines with one key the last counts."""
    pairs = (row.value.split(None, 1) for row in numbered_lines(spark, path).orderBy("file", "line_no").collect())
    return {p[0]: p[1].strip() for p in pairs if len(p) == 2}
