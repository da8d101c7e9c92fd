"""Views that give general tables the shape of the domain's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.operators.candidates import chimeric_pairs, pair_candidates
from junctura.operators.clean import best_rows
from junctura.operators.cluster import assign_labels, region_bounds, region_members

#: Letters in the order of the alphabet and the base that stands for each.
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "AAAAAACCCCCCGGGGGGTTTTTTTT"
REACH, REGION_SUPPORT, EDGE_SUPPORT = 60, 4, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A handful of rows as literals: Spark knows their size, so what is joined with them is not moved to one task a key."""
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def dna(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), LETTERS, BASES), "[^ACGT]", "")


def dna_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, line, s``: the letters of each line as bases, where there are any."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    # A line with a letter has bases; asked of these, a filter would make them a second time.
    return lines.where(F.lower("t").rlike("[a-z]")).select("doc_id", "line", dna(F.col("t")).alias("s"))


DNA = f"regexp_replace(translate(lower({{}}), '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g')"
DNA_LINES = f"""lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents
), dna_lines AS (
    SELECT doc_id, CAST(line AS INTEGER) AS line, {DNA.format("t")} AS s FROM lines WHERE {DNA.format("t")} <> ''
)"""


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alignment for each row of lineitem."""
    quantity = F.col("l_quantity").cast("int")
    virus = F.col("l_suppkey") % 2 == 0
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("read_id"),
        (1 + F.col("l_linenumber") % 2).alias("seg"),
        virus.alias("is_virus"),
        F.when(virus, "v0").otherwise(F.concat(F.lit("h"), (F.expr("l_suppkey div 2") % 2).cast("string"))).alias("chr"),
        F.when(virus, F.col("l_partkey") % 20 * 25).otherwise(F.col("l_partkey") % 40 * 25).alias("pos"),
        (F.col("l_returnflag") == "R").alias("rev"),
        (20 + quantity).alias("rlen"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 3 == 0), quantity).otherwise(0).alias("left_clip"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 3 == 1), quantity).otherwise(0).alias("right_clip"),
        quantity.alias("score"),
        (F.col("l_partkey") % 7 == 0).alias("nonprimary"),
        (F.col("l_suppkey") % 11 == 0).alias("unmapped"),
    )


ALN = """aln AS (
    SELECT l_orderkey AS read_id, 1 + l_linenumber % 2 AS seg, l_suppkey % 2 = 0 AS is_virus,
        CASE WHEN l_suppkey % 2 = 0 THEN 'v0' ELSE 'h' || CAST((l_suppkey // 2) % 2 AS VARCHAR) END AS chr,
        CASE WHEN l_suppkey % 2 = 0 THEN l_partkey % 20 * 25 ELSE l_partkey % 40 * 25 END AS pos,
        l_returnflag = 'R' AS rev, 20 + CAST(l_quantity AS INTEGER) AS rlen,
        CASE WHEN l_linestatus = 'O' AND l_linenumber % 3 = 0 THEN CAST(l_quantity AS INTEGER) ELSE 0 END AS left_clip,
        CASE WHEN l_linestatus = 'F' AND l_linenumber % 3 = 1 THEN CAST(l_quantity AS INTEGER) ELSE 0 END AS right_clip,
        CAST(l_quantity AS INTEGER) AS score, l_partkey % 7 = 0 AS nonprimary, l_suppkey % 11 = 0 AS unmapped
    FROM lineitem
)"""


def best(aln: DataFrame) -> DataFrame:
    """The best alignment of each segment."""
    order = [F.desc("score"), *[F.col(c) for c in ("chr", "pos", "rev", "rlen", "left_clip", "right_clip")]]
    return best_rows(aln, ["read_id", "seg"], order)


BEST = ALN + """, best AS (
    SELECT read_id, seg, is_virus, chr, pos, rev, rlen, left_clip, right_clip, score FROM aln
    QUALIFY row_number() OVER (PARTITION BY read_id, seg ORDER BY score DESC, chr, pos, rev, rlen, left_clip, right_clip) = 1
)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_candidates(chimeric_pairs(best(alignments(spark, sf_dir))))


CAND = BEST + """, pairs AS (
    SELECT h.read_id, h.chr AS h_chr, h.pos AS h_pos, h.rev AS h_rev, h.rlen AS h_rlen, v.chr AS v_chr, v.pos AS v_pos, v.rev AS v_rev, v.rlen AS v_rlen
    FROM best h JOIN best v ON h.read_id = v.read_id AND h.seg <> v.seg AND NOT h.is_virus AND v.is_virus
), cand AS (
    SELECT h_chr AS chr, h_pos + h_rlen AS pos, CASE WHEN h_rev THEN '-' ELSE '+' END AS strand, read_id AS frag_id, false AS is_virus FROM pairs
    UNION
    SELECT v_chr, v_pos, CASE WHEN v_rev THEN '+' ELSE '-' END, read_id, true FROM pairs
)"""


def labels(cand: DataFrame) -> DataFrame:
    return cand.groupBy("chr", "strand", "pos").agg(F.count("*").alias("n"))


LAB = CAND + """, lab AS (
    SELECT chr, strand, pos, count(*) AS n FROM cand GROUP BY ALL
)"""

ASSIGN = LAB + f""", assigned AS (
    SELECT a.chr, a.strand, a.pos, b.pos AS label_pos FROM lab a
    JOIN lab b ON a.chr = b.chr AND a.strand = b.strand AND abs(a.pos - b.pos) <= {REACH}
    QUALIFY rank() OVER (PARTITION BY a.chr, a.strand, a.pos ORDER BY b.n DESC) = 1
)"""


def regions(cand: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions with enough fragments, and their distinct members with the regions' bounds."""
    assigned = assign_labels(labels(cand), REACH)
    bounds = region_bounds(cand, assigned).where(F.col("n_frags") >= REGION_SUPPORT)
    members = region_members(cand, assigned).join(bounds, ["chr", "strand", "label_pos"])
    return bounds, members.select("chr", "strand", "left", "right", "is_virus", "frag_id", "is_split").distinct()


REGIONS = ASSIGN + f""", regions AS (
    SELECT c.chr, c.strand, a.label_pos, least(min(c.pos), a.label_pos) AS "left", greatest(max(c.pos), a.label_pos) AS "right",
        count(DISTINCT frag_id) AS n_frags
    FROM cand c JOIN assigned a USING (chr, strand, pos) GROUP BY c.chr, c.strand, a.label_pos HAVING count(DISTINCT frag_id) >= {REGION_SUPPORT}
), members AS (
    SELECT DISTINCT c.chr, c.strand, r."left", r."right", c.is_virus, c.frag_id
    FROM cand c JOIN assigned a USING (chr, strand, pos) JOIN regions r USING (chr, strand, label_pos)
)"""

EDGE = ["h_chr", "h_strand", "h_left", "h_right", "v_chr", "v_strand", "v_left", "v_right"]

EDGES = REGIONS + f""", edge_reads_all AS (
    SELECT h.chr AS h_chr, h.strand AS h_strand, h."left" AS h_left, h."right" AS h_right,
        v.chr AS v_chr, v.strand AS v_strand, v."left" AS v_left, v."right" AS v_right, h.frag_id
    FROM members h JOIN members v ON h.frag_id = v.frag_id AND NOT h.is_virus AND v.is_virus
), edges AS (
    SELECT {", ".join(EDGE)}, count(*) AS n_reads FROM edge_reads_all GROUP BY ALL HAVING count(*) >= {EDGE_SUPPORT}
), edge_reads AS (
    SELECT r.* FROM edge_reads_all r JOIN edges e USING ({", ".join(EDGE)})
)"""
