"""Queries over the given tables, one or more for each operator, with the SQL that states what each must return."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.config import JunctionConfig
from junctura.functions import sequences as S
from junctura.operators import candidates as C
from junctura.operators import align, clean, cluster, dust, edgeproc, edges, ranges, screen
from junctura.operators import calls as edgestats
from junctura.plans import views as V
from junctura.plans.views import table
from junctura.sources.shared import materialize

CFG = JunctionConfig()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- screening --------------------------------------------------------------------------------------------------------

_MASKED = " UNION ALL ".join(f"SELECT id, p, {m} AS mask, substring(t, p, {3 * m}) || substring(t, p + {3 * m + 3}, {15 - 3 * m}) AS seed FROM {{0}}" for m in range(6))
_KMERS = "SELECT {1} AS id, lower(text) AS t, unnest(range(1, length(text) - 16)) AS p FROM {0} WHERE length(text) >= 18"


@query(f"""WITH rk AS ({_KMERS.format("documents", "doc_id")}), bk AS ({_KMERS.format("benchmark", "item_id")}),
reads AS ({_MASKED.format("rk")}), idx AS (SELECT DISTINCT mask, seed FROM ({_MASKED.format("bk")}))
SELECT id AS doc_id, count(DISTINCT p) AS hits FROM reads SEMI JOIN idx USING (mask, seed) GROUP BY id HAVING count(DISTINCT p) >= 2""")
def seed_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("seq"))
    refs = table(spark, sf_dir, "benchmark").select(F.lower("text").alias("seq"))
    index = screen.seed_index(refs, CFG, strands=False, informative=False)
    return screen.seed_hits(docs, index, CFG, ["doc_id"]).where(F.col("hits") >= CFG.min_seed_hits)


@query(f"""WITH b AS (SELECT item_id, {V.DNA.format("text")} AS s FROM benchmark),
k AS (SELECT item_id, substring(s, p, 15) AS k FROM (SELECT item_id, s, unnest(range(1, length(s) - 13)) AS p FROM b WHERE length(s) >= 15))
SELECT item_id, count(*) AS n_seeds, count(*) FILTER (greatest(15 - length(replace(k, 'A', '')), 15 - length(replace(k, 'C', '')),
    15 - length(replace(k, 'G', '')), 15 - length(replace(k, 'T', ''))) >= 7) AS n_low FROM k GROUP BY item_id""")
def seed_low_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound 7 where the operator's default is 13, as letters drawn from prose are seldom nearly one base."""
    seqs = table(spark, sf_dir, "benchmark").select("item_id", V.dna(F.col("text")).alias("s"))
    seeds = seqs.select("item_id", F.explode(S.kmers(F.col("s"), 15)).alias("kmer"))
    return seeds.groupBy("item_id").agg(F.count("*").alias("n_seeds"), F.count_if(S.max_base_count(F.col("kmer")) >= 7).alias("n_low"))


@query(f"""SELECT doc_id, md5(translate(reverse({V.DNA.format("text")}), 'ACGT', 'TGCA')) AS rc_md5, length({V.DNA.format("text")}) AS n FROM documents""")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = table(spark, sf_dir, "documents").select("doc_id", V.dna(F.col("text")).alias("s"))
    return seqs.select("doc_id", F.md5(F.encode(S.reverse_complement(F.col("s")), "UTF-8")).alias("rc_md5"), F.length("s").cast("long").alias("n"))


_MAX_BASE = "greatest(" + ", ".join(f"length(s) - length(replace(s, '{b}', ''))" for b in "ACGT") + ")"


@query(f"""WITH {V.DNA_LINES}
SELECT doc_id, line, {_MAX_BASE} AS max_base, {_MAX_BASE} >= 0.8 * length(s) AS homopolymer FROM dna_lines""")
def homopolymer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return V.dna_lines(spark, sf_dir).select("doc_id", "line", S.max_base_count(s).cast("long").alias("max_base"), S.is_homopolymer(s).alias("homopolymer"))


@query(f"""WITH {V.DNA_LINES}, d AS (
    SELECT doc_id, line, substring(s, p, 2) AS d FROM (SELECT doc_id, line, s, unnest(range(2, length(s))) AS p FROM dna_lines)
), t AS (
    SELECT doc_id, line, n, row_number() OVER (PARTITION BY doc_id, line ORDER BY n DESC) AS r FROM (SELECT doc_id, line, d, count(*) AS n FROM d GROUP BY ALL)
), u AS (SELECT doc_id, line, sum(n) AS top FROM t WHERE r <= 2 GROUP BY ALL)
SELECT l.doc_id, l.line, CAST(coalesce(top, 0) AS BIGINT) AS top, coalesce(top, 0) >= 0.75 * (length(s) + 1) AS low FROM dna_lines l LEFT JOIN u USING (doc_id, line)""")
def low_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, zero = F.col("s"), F.lit(0)
    return V.dna_lines(spark, sf_dir).select(
        "doc_id", "line", S.top_dinucleotides(s, zero, F.length(s)).cast("long").alias("top"), S.is_low_complexity(s, zero, F.length(s)).alias("low")
    )


@query("""SELECT CAST(floor(avg(s)) AS BIGINT) AS mean_is, sqrt(avg((s - m) * (s - m)) FILTER (s > m)) AS upper_sd,
    CAST(floor(floor(avg(s)) + 5 * sqrt(avg((s - m) * (s - m)) FILTER (s > m))) AS BIGINT) AS max_is,
    CAST(least(ceil(floor(avg(s)) + 5 * sqrt(avg((s - m) * (s - m)) FILTER (s > m))), 1000) AS BIGINT) AS max_is_capped
FROM (SELECT l_quantity * 10 AS s FROM lineitem) CROSS JOIN (SELECT floor(avg(l_quantity * 10)) AS m FROM lineitem)""")
def insert_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.insert_size_stats(table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 10).alias("size")), bound=CFG.max_insert_bound)


# -- strings of alignments --------------------------------------------------------------------------------------------


@query(f"""WITH {V.ALN}
SELECT read_id, seg, chr, NOT rev AS rev, pos + k AS pos, CAST(rlen AS VARCHAR) || 'M' AS cigar, score AS nm
FROM aln, (VALUES (0), (7)) AS a(k)""")
def xa_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    aln = V.alignments(spark, sf_dir)
    cigar = F.concat(F.col("rlen").cast("string"), F.lit("M"))
    xa = F.concat(*[S.alternative_text(F.col("chr"), ~F.col("rev"), F.col("pos") + k, cigar, F.col("score")) for k in (0, 7)])
    return aln.select("read_id", "seg", F.inline(S.parse_alternatives(xa)))


_CIGAR = """CASE WHEN left_clip > 0 THEN CAST(left_clip AS VARCHAR) || 'S' ELSE '' END || CAST(rlen AS VARCHAR) || 'M2D5=3I4X'
    || CASE WHEN right_clip > 0 THEN CAST(right_clip AS VARCHAR) || 'S' ELSE '' END"""


def _cigar(df: DataFrame) -> DataFrame:
    def clip(c: str):
        return F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit("S"))).otherwise("")

    return df.withColumn("cigar", F.concat(clip("left_clip"), F.col("rlen").cast("string"), F.lit("M2D5=3I4X"), clip("right_clip")))


@query(f"""WITH {V.ALN} SELECT read_id, seg, {_CIGAR} AS cigar, rlen + 11 AS ref_len, pos + rlen + 11 AS "end",
    CASE WHEN left_clip > 0 THEN 1 ELSE 0 END + CASE WHEN right_clip > 0 THEN 2 ELSE 0 END AS side,
    replace(replace({_CIGAR}, '5=', '5M'), '4X', '4M') AS collapsed FROM aln""")
def cigar_ref_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    cigar = F.col("cigar")
    return _cigar(V.alignments(spark, sf_dir)).select(
        "read_id", "seg", "cigar", S.reference_length(cigar).alias("ref_len"), S.end_position(F.col("pos"), cigar).alias("end"), S.clip_side(cigar).alias("side"), S.collapse_matches(cigar).alias("collapsed")
    )


# -- cleaning ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {V.ALN}, n AS (SELECT read_id, seg, count(DISTINCT (chr, pos, rev)) AS x2 FROM aln GROUP BY ALL)
SELECT a.read_id, a.seg, a.x2, coalesce(b.x2, 0) AS y2 FROM n a LEFT JOIN n b ON a.read_id = b.read_id AND a.seg <> b.seg
WHERE a.x2 <= 6 AND coalesce(b.x2, 0) <= 6""")
def alt_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = CFG.max_alternatives
    return clean.alternative_counts(V.alignments(spark, sf_dir), ["chr", "pos", "rev"]).where((F.col("x2") <= most) & (F.col("y2") <= most))


_BEST_READ = "row_number() OVER (PARTITION BY read_id ORDER BY nonprimary, unmapped, score DESC NULLS LAST, seg, chr, pos, rev) = 1"


@query(f"WITH {V.ALN} SELECT read_id, seg, chr, pos, rev, score, nonprimary, unmapped FROM aln QUALIFY {_BEST_READ}")
def best_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.best_alignment(V.alignments(spark, sf_dir)).select("read_id", "seg", "chr", "pos", "rev", "score", "nonprimary", "unmapped")


@query(f"""WITH {V.ALN}, b AS (SELECT read_id, seg AS b_seg, 'v0' AS b_mate_chr, pos % 500 AS b_mate_pos FROM aln QUALIFY {_BEST_READ})
SELECT read_id, seg, chr, pos, rev, score, chr = b_mate_chr AND pos = b_mate_pos AS pointed FROM aln JOIN b USING (read_id) WHERE seg <> b_seg
QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY (chr = b_mate_chr AND pos = b_mate_pos) DESC, nonprimary, unmapped, score DESC NULLS LAST, chr, pos, rev) = 1""")
def best_mate(spark: SparkSession, sf_dir: str) -> DataFrame:
    aln = V.alignments(spark, sf_dir)
    best = clean.best_alignment(aln).select("read_id", F.col("seg").alias("b_seg"), F.lit("v0").alias("b_mate_chr"), (F.col("pos") % 500).alias("b_mate_pos"))
    pointed = (F.col("chr") == F.col("b_mate_chr")) & (F.col("pos") == F.col("b_mate_pos"))
    return clean.best_mate(aln, best).select("read_id", "seg", "chr", "pos", "rev", "score", pointed.alias("pointed"))


@query(f"""WITH {V.ALN}, r AS (
    SELECT read_id, seg, chr, pos, rev, is_virus, CASE WHEN left_clip > 0 THEN 1 WHEN right_clip > 0 THEN 2 ELSE 0 END AS side, score % 2 = 0 AS a_rev, score % 3 = 0 AS a_virus, 1 + score % 2 AS a_side FROM aln
)
SELECT read_id, seg, chr, pos, rev FROM r WHERE NOT (side > 0 AND a_virus = is_virus AND a_side = CASE WHEN a_rev = rev THEN 3 - side ELSE side END)""")
def template_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    aln = _cigar(V.alignments(spark, sf_dir))
    alt = F.struct(
        F.col("chr"), (F.col("score") % 2 == 0).alias("rev"), F.col("pos"), F.when(F.col("score") % 2 == 0, "9S40M").otherwise("40M9S").alias("cigar"),
        F.lit(0).alias("nm"), (F.col("score") % 3 == 0).alias("is_virus"),
    )
    return clean.without_template_switches(aln.withColumn("alts", F.array(alt))).select("read_id", "seg", "chr", "pos", "rev")


# -- candidates -------------------------------------------------------------------------------------------------------

_CLIPS = """clips AS (
    SELECT read_id, seg, is_virus AS anchor_is_virus, CASE WHEN left_clip >= 20 THEN 'L' ELSE 'R' END AS side, greatest(left_clip, right_clip) AS clip_len, chr, pos, rev, rlen
    FROM best WHERE (left_clip >= 20) <> (right_clip >= 20)
)"""
_SPLIT = """CASE WHEN anchor_is_virus THEN CASE WHEN (side = 'L') = NOT rev THEN '+' ELSE '-' END ELSE CASE WHEN side = 'L' THEN '-' ELSE '+' END END AS host_strand,
    CASE WHEN anchor_is_virus THEN CASE WHEN side = 'L' THEN '+' ELSE '-' END WHEN side = 'L' THEN CASE WHEN rev THEN '+' ELSE '-' END ELSE CASE WHEN rev THEN '-' ELSE '+' END END AS virus_strand"""


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.extract_clips(V.best(V.alignments(spark, sf_dir)), CFG.min_clip_size)


@query(f"WITH {V.BEST}, {_CLIPS} SELECT read_id, seg, side, anchor_is_virus, clip_len FROM clips")
def clip_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir).select("read_id", "seg", "side", "anchor_is_virus", "clip_len")


@query(f"WITH {V.BEST}, {_CLIPS} SELECT read_id, seg, {_SPLIT} FROM clips")
def split_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clip's own strand is taken from the anchor's row, as lineitem holds no second alignment."""
    host, virus = S.split_strands(F.col("anchor_is_virus"), F.col("side"), F.col("rev"))
    return _clips(spark, sf_dir).select("read_id", "seg", host.alias("host_strand"), virus.alias("virus_strand"))


@query(f"WITH {V.CAND} SELECT read_id, CASE WHEN h_rev THEN '-' ELSE '+' END AS host_strand, CASE WHEN v_rev THEN '+' ELSE '-' END AS virus_strand FROM pairs")
def pair_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, virus = S.pair_strands(F.col("h_rev"), F.col("v_rev"))
    return C.chimeric_pairs(V.best(V.alignments(spark, sf_dir))).select("read_id", host.alias("host_strand"), virus.alias("virus_strand"))


@query(f"""WITH {V.CAND}, {_CLIPS}
SELECT p.* FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM clips c WHERE c.read_id = p.read_id)
AND NOT EXISTS (SELECT 1 FROM aln a JOIN best b ON a.read_id = b.read_id AND a.seg = b.seg WHERE a.read_id = p.read_id AND a.is_virus <> b.is_virus)""")
def chimeric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    aln = V.alignments(spark, sf_dir)
    best = V.best(aln)
    alts = best.select("read_id", "seg", "is_virus").join(aln.select("read_id", "seg", F.col("is_virus").alias("alt_is_virus")), ["read_id", "seg"])
    pairs = C.usable_pairs(C.chimeric_pairs(best), C.extract_clips(best, CFG.min_clip_size), alts)
    return pairs.select("read_id", *[f"{s}_{c}" for s in "hv" for c in ("chr", "pos", "rev", "rlen")])


_SPLIT_CAND = f"""other AS (
    SELECT read_id, seg AS c_seg, chr AS c_chr, pos AS c_pos, pos + rlen AS c_end, rev AS c_rev, is_virus AS c_is_virus FROM best
), split_pairs AS (
    SELECT c.read_id, c.seg, c.anchor_is_virus, c.chr, CASE WHEN side = 'L' THEN c.pos ELSE c.pos + c.rlen END AS a_pos, c_chr, CASE WHEN side = 'L' THEN c_end ELSE c_pos END AS c_at,
        {_SPLIT.replace("rev", "c_rev")}
    FROM clips c JOIN other o ON c.read_id = o.read_id AND c.seg <> o.c_seg AND c.anchor_is_virus <> o.c_is_virus
), split_cand AS (
    SELECT chr, a_pos AS pos, CASE WHEN anchor_is_virus THEN virus_strand ELSE host_strand END AS strand, read_id AS frag_id, anchor_is_virus AS is_virus FROM split_pairs
    UNION SELECT c_chr, c_at, CASE WHEN anchor_is_virus THEN host_strand ELSE virus_strand END, read_id, NOT anchor_is_virus FROM split_pairs
)"""


@query(f"""WITH {V.CAND}, {_CLIPS}, {_SPLIT_CAND}, u AS (
    SELECT chr, pos, strand, frag_id, is_virus, true AS is_split FROM split_cand
    UNION SELECT chr, pos, strand, frag_id, is_virus, false FROM cand WHERE frag_id NOT IN (SELECT read_id FROM clips)
)
SELECT chr, strand, is_virus, pos, count(DISTINCT frag_id) AS n_frags, bool_and(is_split) AS split_only FROM u GROUP BY ALL""")
def junction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of every candidate place, from split reads (the clip lies where the mate does) and from other pairs."""
    best = V.best(V.alignments(spark, sf_dir))
    clips = C.extract_clips(best, CFG.min_clip_size)
    anchors = clips.select("read_id", "seg", "side", "anchor_is_virus", "chr", "pos", (F.col("pos") + F.col("rlen")).alias("end"))
    mates = best.select("read_id", (3 - F.col("seg")).alias("seg"), F.col("chr").alias("c_chr"), F.col("pos").alias("c_pos"), (F.col("pos") + F.col("rlen")).alias("c_end"), F.col("rev").alias("c_rev"), F.col("is_virus").alias("c_is_virus"))
    placed = anchors.select("read_id", "seg", "side", "anchor_is_virus").join(mates, ["read_id", "seg"]).where("anchor_is_virus <> c_is_virus").drop("anchor_is_virus")
    split = C.split_candidates(anchors, placed).drop("seg").distinct().withColumn("is_split", F.lit(True))
    pairs = C.pair_candidates(C.usable_pairs(C.chimeric_pairs(best), clips)).withColumn("is_split", F.lit(False))
    support = split.unionByName(pairs).groupBy("chr", "strand", "is_virus", "pos")
    return support.agg(F.count_distinct("frag_id").alias("n_frags"), F.bool_and("is_split").alias("split_only"))


_BED = "bed(chr, ex_start, ex_end) AS (VALUES ('h0', 100, 260), ('h0', 240, 300), ('h1', 0, 30), ('v0', 200, 210), ('v0', 220, 225), ('v1', 0, 9))"
_BED_ROWS = [("h0", 100, 260), ("h0", 240, 300), ("h1", 0, 30), ("v0", 200, 210), ("v0", 220, 225), ("v1", 0, 9)]


def _bed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_BED_ROWS, "chr string, ex_start long, ex_end long")


@query(f"""WITH {V.CAND}, {_BED} SELECT chr, pos, pos + 1 AS "end", strand, frag_id FROM cand c
WHERE NOT EXISTS (SELECT 1 FROM bed b WHERE b.chr = c.chr AND c.pos < b.ex_end AND c.pos + 1 > b.ex_start)""")
def excluded_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = V.candidates(spark, sf_dir).withColumn("end", F.col("pos") + 1)
    return ranges.exclude(spans, _bed(spark), start="pos", end="end").select("chr", "pos", "end", "strand", "frag_id")


@query(f"""WITH {V.REGIONS}, {_BED}, spans AS (SELECT chr, strand, label_pos, "left" AS s, "right" + 1 AS e FROM regions),
base AS (SELECT chr, strand, label_pos, s, e, unnest(range(s, e)) AS p FROM spans),
kept AS (SELECT * FROM base x WHERE NOT EXISTS (SELECT 1 FROM bed b WHERE b.chr = x.chr AND x.p >= b.ex_start AND x.p < b.ex_end)),
runs AS (SELECT *, p - row_number() OVER (PARTITION BY chr, strand, label_pos ORDER BY p) AS g FROM kept)
SELECT chr, strand, label_pos, min(p) AS s, max(p) + 1 AS e FROM runs GROUP BY chr, strand, label_pos, g""")
def excluded_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds, _ = V.regions(V.candidates(spark, sf_dir))
    spans = bounds.select("chr", "strand", "label_pos", F.col("left").alias("s"), (F.col("right") + 1).alias("e"))
    return ranges.exclude(spans, _bed(spark), start="s", end="e", trim=True)


# -- regions ----------------------------------------------------------------------------------------------------------


@query(f"WITH {V.LAB} SELECT chr, strand, pos, n, CAST(dense_rank() OVER (PARTITION BY chr, strand ORDER BY n DESC) AS INTEGER) AS tier FROM lab")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.label_tiers(V.labels(V.candidates(spark, sf_dir))).select("chr", "strand", "pos", "n", "tier")


@query(f"WITH {V.ASSIGN} SELECT * FROM assigned")
def cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assign_labels(V.labels(V.candidates(spark, sf_dir)), V.REACH)


@query(f"WITH {V.REGIONS} SELECT * FROM regions")
def region_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.regions(V.candidates(spark, sf_dir))[0]


def _rounds(n: int) -> str:
    parts = [V.ASSIGN, 'm0 AS (SELECT DISTINCT c.chr, c.strand, a.label_pos, c.is_virus, c.frag_id FROM cand c JOIN assigned a USING (chr, strand, pos))']
    for k in range(n):
        parts.append(f"s{k} AS (SELECT chr, strand, label_pos FROM m{k} GROUP BY ALL HAVING count(DISTINCT frag_id) >= 30)")
        parts.append(f"k{k} AS (SELECT * FROM m{k} SEMI JOIN s{k} USING (chr, strand, label_pos))")
        parts.append(f"f{k} AS (SELECT frag_id FROM k{k} GROUP BY frag_id HAVING count(DISTINCT is_virus) = 2)")
        parts.append(
            f"m{k + 1} AS (SELECT * FROM k{k} WHERE (SELECT count(*) FROM k{k}) = (SELECT count(*) FROM m{k})"
            f" UNION ALL SELECT * FROM k{k} SEMI JOIN f{k} USING (frag_id) WHERE (SELECT count(*) FROM k{k}) < (SELECT count(*) FROM m{k}))"
        )
    return ", ".join(parts)


@query(f"WITH {_rounds(6)} SELECT chr, strand, label_pos, is_virus, frag_id FROM m6")
def region_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support 30, where the default 4 drops hardly a region of these tables."""
    cand = V.candidates(spark, sf_dir)
    members = cluster.region_members(cand, cluster.assign_labels(V.labels(cand), V.REACH))
    kept = cluster.filter_fixpoint(members, ["chr", "strand", "label_pos"], support=30)
    return kept.select("chr", "strand", "label_pos", "is_virus", "frag_id")


# -- edges ------------------------------------------------------------------------------------------------------------

_E = ", ".join(V.EDGE)


def _edge_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = V.regions(V.candidates(spark, sf_dir))
    reads = materialize(edges.enumerate_edges(members, ["chr", "strand", "left", "right"]), "edge-reads")
    return reads.join(edges.supported_edges(reads, V.EDGE, V.EDGE_SUPPORT).select(*V.EDGE), V.EDGE, "left_semi")


@query(f"WITH {V.EDGES} SELECT * FROM edges")
def edge_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = V.regions(V.candidates(spark, sf_dir))
    return edges.supported_edges(edges.enumerate_edges(members, ["chr", "strand", "left", "right"]), V.EDGE, V.EDGE_SUPPORT)


_BLOCKS = """blocks AS (
    SELECT *, CAST(sum(o) OVER (PARTITION BY h_chr, h_strand, v_chr, v_strand ORDER BY h_left, h_right, v_left, v_right ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM (
        SELECT *, CASE WHEN h_left <= max(h_right) OVER (PARTITION BY h_chr, h_strand, v_chr, v_strand ORDER BY h_left, h_right, v_left, v_right
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM edges)
)"""


@query(f"WITH {V.EDGES}, {_BLOCKS} SELECT {_E}, block FROM blocks")
def edge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.edge_blocks(_edge_reads(spark, sf_dir).select(*V.EDGE).distinct())


_CONTAINS = """a.h_chr = b.h_chr AND a.h_strand = b.h_strand AND a.v_chr = b.v_chr AND a.v_strand = b.v_strand
    AND b.h_left <= a.h_left AND a.h_right <= b.h_right AND b.v_left <= a.v_left AND a.v_right <= b.v_right"""
_DIFFERS = "(a.h_left <> b.h_left OR a.h_right <> b.h_right OR a.v_left <> b.v_left OR a.v_right <> b.v_right)"


@query(f"""WITH {V.EDGES}, top AS (SELECT * FROM edges a WHERE NOT EXISTS (SELECT 1 FROM edges b WHERE {_CONTAINS} AND {_DIFFERS})),
target AS (
    SELECT a.*, b.h_left AS th_left, b.h_right AS th_right, b.v_left AS tv_left, b.v_right AS tv_right FROM edges a JOIN top b ON {_CONTAINS}
    QUALIFY row_number() OVER (PARTITION BY {", ".join("a." + c for c in V.EDGE)} ORDER BY b.h_left, b.h_right, b.v_left, b.v_right) = 1
)
SELECT h_chr, h_strand, th_left AS h_left, th_right AS h_right, v_chr, v_strand, tv_left AS v_left, tv_right AS v_right, count(DISTINCT frag_id) AS n_reads
FROM edge_reads JOIN target USING ({_E}) GROUP BY ALL""")
def edge_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.subsume(_edge_reads(spark, sf_dir)).groupBy(*V.EDGE).agg(F.count("*").alias("n_reads"))


@query(f"""WITH {V.EDGES} SELECT {_E}, greatest(h_left - 500, 0) AS h_from, least(h_right + 500, 1050) AS h_to, greatest(v_left - 500, 0) AS v_from, least(v_right + 500, 500) AS v_to FROM edges""")
def slop_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edge_reads(spark, sf_dir).select(*V.EDGE).distinct()
    h = S.slop(F.col("h_left"), F.col("h_right"), F.lit(CFG.max_is), F.lit(1050))
    v = S.slop(F.col("v_left"), F.col("v_right"), F.lit(CFG.max_is), F.lit(500))
    return e.select("*", h[0].alias("h_from"), h[1].alias("h_to"), v[0].alias("v_from"), v[1].alias("v_to"))


@query(f"""WITH {V.REGIONS}, w AS (SELECT DISTINCT chr, "left" AS a, "right" + 60 AS b FROM regions),
p AS (SELECT DISTINCT chr, unnest(range(pos, pos + rlen)) AS p FROM best)
SELECT w.chr, a AS w_start, b AS w_end, count(p.p) AS covered, count(p.p) / (b - a) AS share FROM w LEFT JOIN p ON w.chr = p.chr AND p.p >= a AND p.p < b GROUP BY w.chr, a, b""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds, _ = V.regions(V.candidates(spark, sf_dir))
    windows = bounds.select("chr", F.col("left").alias("w_start"), (F.col("right") + 60).alias("w_end")).distinct().withColumn("id", F.struct("chr", "w_start", "w_end"))
    spans = V.best(V.alignments(spark, sf_dir)).select("chr", F.col("pos").alias("s"), (F.col("pos") + F.col("rlen")).alias("e"))
    return ranges.covered_share(windows, spans).select("id.chr", "id.w_start", "id.w_end", "covered", "share")


@query(f"WITH {V.EDGES}, u AS (SELECT frag_id, count(*) AS n FROM edge_reads GROUP BY ALL) SELECT {_E}, count(*) AS n_reads, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_unique FROM edge_reads JOIN u USING (frag_id) GROUP BY ALL")
def unique_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.unique_reads(_edge_reads(spark, sf_dir), V.EDGE)


@query(f"""WITH {V.EDGES}, s AS (SELECT DISTINCT {_E}, frag_id // 2 AS read_id, CASE WHEN frag_id % 3 = 0 THEN 1 + frag_id % 2 END AS seg FROM edge_reads),
w AS (SELECT *, CASE WHEN seg IS NOT NULL AND count(*) OVER (PARTITION BY {_E}, read_id) > 1 THEN 0.5 ELSE 1.0 END AS x FROM s)
SELECT {_E}, CAST(sum(x) + max(CASE WHEN seg IS NULL THEN 0 ELSE 1 END) AS DOUBLE) AS effective FROM w GROUP BY ALL HAVING sum(x) + max(CASE WHEN seg IS NULL THEN 0 ELSE 1 END) >= 4""")
def effective_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _edge_reads(spark, sf_dir)
    split = reads.withColumn("read_id", F.expr("frag_id div 2")).withColumn("seg", F.when(F.col("frag_id") % 3 == 0, 1 + F.col("frag_id") % 2))
    return edges.effective_reads(split, V.EDGE).where(F.col("effective") >= CFG.edge_reads)


# -- alignments of edges ----------------------------------------------------------------------------------------------

_EDGE_ALN = """edge_aln AS (
    SELECT r.*, h.score AS h_score, v.score AS v_score, h.pos AS h_begin, h.pos + h.rlen - 1 AS h_end, v.pos AS v_begin, v.pos + v.rlen - 1 AS v_end, h.rlen AS h_len, v.rlen AS v_len
    FROM edge_reads r JOIN best h ON h.read_id = r.frag_id AND NOT h.is_virus JOIN best v ON v.read_id = r.frag_id AND v.is_virus
)"""


def _edge_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge reads with the alignments of both sides; the best alignment on an organism serves for all its regions."""
    best = V.best(V.alignments(spark, sf_dir))
    side = F.when(F.col("is_virus"), "v").otherwise("h")
    found = best.groupBy(side.alias("region_id"), F.col("read_id").alias("frag_id")).agg(F.max(F.struct("pos", "rlen", "score")).alias("a"))
    facts = found.select("region_id", "frag_id", "a.score", F.col("a.pos").alias("begin"), (F.col("a.pos") + F.col("a.rlen") - 1).alias("end"), F.col("a.rlen").alias("len"))
    reads = _edge_reads(spark, sf_dir).withColumns({"h_region": F.lit("h"), "v_region": F.lit("v")})
    both = align.on_both_sides(reads, facts, ["score", "begin", "end", "len"])
    return both.select(*V.EDGE, "frag_id", *[f"{s}_{c}" for s in "hv" for c in ("score", "begin", "end", "len")])


@query(f"""WITH {V.ALN}, t AS (SELECT *, max(score) OVER (PARTITION BY read_id, is_virus) AS top FROM aln WHERE score >= 30 AND rlen >= 30 AND NOT (left_clip > 0 AND right_clip > 0))
SELECT read_id, seg, is_virus, chr, pos, score FROM t WHERE score >= 0.75 * top
AND read_id IN (SELECT read_id FROM t WHERE score >= 0.75 * top AND is_virus) AND read_id IN (SELECT read_id FROM t WHERE score >= 0.75 * top AND NOT is_virus)""")
def relative_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted alignments near their read's best on an organism, of reads that have some on both."""
    aln = _cigar(V.alignments(spark, sf_dir)).withColumn("ref_begin", F.col("pos")).withColumn("ref_end", F.col("pos") + F.col("rlen") - 1)
    good = align.relative(align.accepted(aln, CFG), ["read_id", "is_virus"], CFG)
    return align.reads_on_both_organisms(good).select("read_id", "seg", "is_virus", "chr", "pos", "score")


@query(f"WITH {V.EDGES}, {_EDGE_ALN} SELECT {_E}, CAST(sum(h_score + v_score) AS BIGINT) AS score FROM edge_aln GROUP BY ALL")
def edge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edgestats.call_statistics(_edge_alignments(spark, sf_dir), V.EDGE, CFG).select(*V.EDGE, "score")


@query(f"WITH {V.EDGES}, {_EDGE_ALN} SELECT {_E}, max(h_end) AS h_bp, min(v_begin) AS v_bp FROM edge_aln GROUP BY ALL")
def breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edgestats.call_statistics(_edge_alignments(spark, sf_dir), V.EDGE, CFG).select(*V.EDGE, "h_bp", "v_bp")


@query(f"""WITH {V.EDGES}, {_EDGE_ALN} SELECT {_E}, count(*) AS reads, round(avg(h_score / h_len), 6) AS host_pbs, round(avg(v_score / v_len), 6) AS virus_pbs,
    round((max(h_end) - min(h_begin)) / 470.0, 6) AS host_cov, round((max(v_end) - min(v_begin)) / 500.0, 6) AS virus_cov FROM edge_aln GROUP BY ALL""")
def call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = edgestats.call_statistics(_edge_alignments(spark, sf_dir), V.EDGE, CFG)
    return stats.select(*V.EDGE, "reads", *[F.round(c, 6).alias(c) for c in ("host_pbs", "virus_pbs", "host_cov", "virus_cov")])


@query(f"""WITH {V.EDGES}, {_EDGE_ALN}, b AS (SELECT {_E}, max(h_end) AS h_bp, min(v_begin) AS v_bp FROM edge_aln GROUP BY ALL)
SELECT {_E}, frag_id FROM edge_aln JOIN b USING ({_E}) WHERE 2 + abs(h_bp - h_begin) + abs(v_bp - v_end) <= 500""")
def insert_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _edge_alignments(spark, sf_dir)
    bp = edgestats.call_statistics(reads, V.EDGE, CFG).select(*V.EDGE, "h_bp", "v_bp")
    ends = reads.join(bp, V.EDGE).withColumn("h_distal", S.distal(F.lit(False), F.col("h_begin"), F.col("h_end"))).withColumn("v_distal", S.distal(F.lit(True), F.col("v_begin"), F.col("v_end")))
    return edgeproc.within_insert_size(ends, CFG.max_is).select(*V.EDGE, "frag_id")


@query(f"""WITH {V.DNA_LINES}, l AS (SELECT doc_id, line, unnest(range(length(s))) AS p, unnest(string_split(s, '')) AS letter FROM dna_lines),
c AS (SELECT doc_id, p, letter, count(*) AS n, max(line) AS latest FROM l GROUP BY doc_id, p, letter),
w AS (SELECT doc_id, p, letter FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, p ORDER BY n DESC, latest) = 1)
SELECT doc_id, string_agg(letter, '' ORDER BY p) AS consensus FROM w GROUP BY doc_id""")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority letter of each column of a document's lines, laid one under the other."""
    return edgeproc.consensus(V.dna_lines(spark, sf_dir), ["doc_id"], "line", "s")


def _first_rounds(n: int) -> str:
    """Reads that stay, in rounds: those first at both their ends stay, all others there go."""
    parts = [f"u0 AS (SELECT DISTINCT {_E}, frag_id, h_begin AS h_distal, v_end AS v_distal FROM edge_aln)"]
    for k in range(n):
        parts.append(f"f{k} AS (SELECT * FROM u{k} QUALIFY frag_id = min(frag_id) OVER (PARTITION BY {_E}, h_distal) AND frag_id = min(frag_id) OVER (PARTITION BY {_E}, v_distal))")
        parts.append(f"u{k + 1} AS (SELECT * FROM u{k} ANTI JOIN f{k} USING ({_E}, h_distal) ANTI JOIN f{k} g USING ({_E}, v_distal))")
    return ", ".join(parts)


@query(f"""WITH {V.EDGES}, {_EDGE_ALN}, {_first_rounds(8)}
{" UNION ALL ".join(f"SELECT {_E}, frag_id, h_distal, v_distal FROM f{k}" for k in range(8))} UNION ALL SELECT {_E}, frag_id, h_distal, v_distal FROM u8""")
def dedup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _edge_alignments(spark, sf_dir)
    return edgeproc.remove_duplicates(reads.select(*V.EDGE, "frag_id", F.col("h_begin").alias("h_distal"), F.col("v_end").alias("v_distal")), V.EDGE)


@query()
def dedup_edges_exploratory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that share one end only are duplicates only where their joint CIGARs are consistent."""
    reads = _edge_alignments(spark, sf_dir)
    joint = S.joint_cigar(F.concat(F.col("h_len").cast("string"), F.lit("=")), F.concat(F.col("v_len").cast("string"), F.lit("=3S")), F.lit(False), F.lit(False))
    rows = reads.select(*V.EDGE, "frag_id", F.col("h_begin").alias("h_distal"), F.col("v_end").alias("v_distal"), joint.alias("joint"))
    return edgeproc.remove_duplicates(rows, V.EDGE, replace(CFG, exploratory=True).exploratory)


@query()
def split_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines as the reads of an edge: what is left of each, and what is split off as consistent parts."""
    rows = V.dna_lines(spark, sf_dir).select("doc_id", F.col("line").alias("frag_id"), F.col("s").alias("seq"))
    parts = edgeproc.split_edges(rows, ["doc_id"], CFG)
    return edgeproc.with_parts(rows.select("doc_id", "frag_id"), parts, ["doc_id"])


@query()
def pack_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _edge_alignments(spark, sf_dir).select(*V.EDGE, "frag_id", (F.col("h_score") + F.col("v_score")).alias("score"))
    return edgeproc.pack_edges(reads, V.EDGE, CFG)


# -- calls ------------------------------------------------------------------------------------------------------------

_CALLS = """calls AS (
    SELECT o_orderkey AS call_id, 'h' || CAST(o_custkey % 2 AS VARCHAR) AS host_chr, o_orderstatus = 'F' AS host_rev, CAST(floor(o_totalprice) AS BIGINT) AS host_pos,
        o_custkey % 9 AS good_pairs, o_orderkey % 3 AS split_reads, (o_custkey % 100) / 100.0 AS host_pbs, (o_orderkey % 90) / 90.0 AS host_cov, (o_custkey % 80) / 80.0 AS virus_cov,
        o_custkey % 300 AS host_len, o_orderkey % 310 AS virus_len, o_orderkey % 200 AS host_masked, o_custkey % 210 AS virus_masked
    FROM orders
)"""
_ACCEPT = """((host_pbs >= 0.8 AND (good_pairs >= 4 OR (good_pairs = 3 AND split_reads > 0)) AND host_len >= 75 AND virus_len >= 75)
    OR ((host_cov + virus_cov) / 2 >= 0.5 AND good_pairs > 2))
    AND NOT (host_len > 0 AND host_masked > 0.8 * host_len) AND NOT (virus_len > 0 AND virus_masked > 0.8 * virus_len)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        o.alias("call_id"), F.concat(F.lit("h"), (c % 2).cast("string")).alias("host_chr"), (F.col("o_orderstatus") == "F").alias("host_rev"), F.floor("o_totalprice").cast("long").alias("host_pos"),
        (c % 9).alias("good_pairs"), (o % 3).alias("split_reads"), ((c % 100) / 100.0).alias("host_pbs"), ((o % 90) / 90.0).alias("host_cov"), ((c % 80) / 80.0).alias("virus_cov"),
        (c % 300).alias("host_len"), (o % 310).alias("virus_len"), (o % 200).alias("host_masked"), (c % 210).alias("virus_masked"),
    )


@query(f"WITH {_CALLS} SELECT call_id, {_ACCEPT} AS accepted FROM calls")
def accept_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edgestats.accept_calls(_calls(spark, sf_dir), CFG).select("call_id", "accepted")


@query(f"""WITH {_CALLS}, d AS (
    SELECT a.call_id AS a, b.call_id AS b, a.host_pos - b.host_pos AS dist FROM calls a JOIN calls b
    ON a.host_chr = b.host_chr AND a.host_rev AND NOT b.host_rev AND a.host_pos - b.host_pos BETWEEN -50 AND 1000
), u AS (SELECT a AS call_id, b AS mate_id, dist FROM d UNION ALL SELECT b, a, dist FROM d)
SELECT call_id, mate_id, dist FROM u QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY abs(dist), mate_id) = 1""")
def nearest_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edgestats.nearest_mates(_calls(spark, sf_dir), CFG)


def _pair_rounds(name: str, n: int) -> str:
    """Rounds over the candidate pairs ``name``0 (a, b, one, far, other): a pair that comes first for both its calls is taken."""
    order = "ORDER BY one, far, other"
    parts = []
    for k in range(n):
        parts.append(f"{name}t{k} AS MATERIALIZED (SELECT a, b FROM {name}{k} QUALIFY row_number() OVER (PARTITION BY a {order}) = 1 AND row_number() OVER (PARTITION BY b {order}) = 1)")
        parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT * FROM {name}{k} WHERE a NOT IN (SELECT a FROM {name}t{k}) AND b NOT IN (SELECT b FROM {name}t{k}))")
    return ", ".join(parts) + f", {name} AS (" + " UNION ALL ".join(f"SELECT a, b FROM {name}t{k}" for k in range(n)) + ")"


@query(f"""WITH {_CALLS}, c AS (SELECT call_id, host_chr, host_rev, host_pos, {_ACCEPT} AS ok FROM calls),
near AS (SELECT x.call_id AS a, y.call_id AS b, x.ok AS a_ok, y.ok AS b_ok, abs(x.host_pos - y.host_pos) AS far FROM c x JOIN c y ON x.host_chr = y.host_chr AND x.host_rev AND NOT y.host_rev AND x.host_pos - y.host_pos BETWEEN -50 AND 1000),
p0 AS MATERIALIZED (SELECT a, b, least(a, b) AS one, far, greatest(a, b) AS other FROM near WHERE a_ok AND b_ok), {_pair_rounds("p", 24)},
q0 AS MATERIALIZED (SELECT a, b, CASE WHEN a_ok THEN a ELSE b END AS one, far, CASE WHEN a_ok THEN b ELSE a END AS other FROM near WHERE a_ok <> b_ok AND a NOT IN (SELECT a FROM p) AND b NOT IN (SELECT b FROM p)), {_pair_rounds("q", 24)},
u AS (SELECT * FROM p UNION ALL SELECT * FROM q) SELECT a AS call_id, b AS paired_with FROM u UNION ALL SELECT b, a FROM u""")
def pair_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edgestats.pair_calls(edgestats.accept_calls(_calls(spark, sf_dir), CFG), CFG)


@query(f"""WITH {_CALLS} SELECT call_id, concat_ws(' ', call_id,
    host_chr || ':' || CASE WHEN host_rev THEN '-' ELSE '+' END || ':' || host_pos || ':' || (host_pos + 10),
    'v0:' || CASE WHEN host_rev THEN '-' ELSE '+' END || ':' || host_len || ':' || (host_len + 10),
    good_pairs, good_pairs, split_reads, host_len, printf('%.6f', host_pbs), printf('%.6f', host_pbs), 0, 0, printf('%.6f', host_cov), printf('%.6f', virus_cov)) AS raw,
    'ID=' || call_id || ' ' || host_chr || ':' || CASE WHEN host_rev THEN '-' || host_pos ELSE '+' || (host_pos + 10) END
    || ' v0:' || CASE WHEN host_rev THEN '-' || host_len ELSE '+' || (host_len + 10) END || ' SUPPORTING_PAIRS=' || good_pairs || ' SPLIT_READS=' || split_reads
    || ' HOST_PBS=' || printf('%.6f', host_pbs) || ' COVERAGE=' || printf('%.6f', (host_cov + virus_cov) / 2)
    || CASE WHEN split_reads > 0 THEN ' PAIRED WITH ID=' || (call_id + 1) ELSE '' END AS report FROM calls""")
def format_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir).withColumns({
        "virus_chr": F.lit("v0"), "virus_rev": F.col("host_rev"), "host_start": F.col("host_pos"), "host_end": F.col("host_pos") + 10, "virus_start": F.col("host_len"), "virus_end": F.col("host_len") + 10,
        "reads": F.col("good_pairs"), "score": F.col("host_len"), "virus_pbs": F.col("host_pbs"), "reads_w_dups": F.lit(0), "unique_reads_w_dups": F.lit(0),
        "paired_with": F.when(F.col("split_reads") > 0, F.col("call_id") + 1),
    })
    return calls.select("call_id", edgestats.raw_line().alias("raw"), edgestats.report_line().alias("report"))


# -- sequence kernels -------------------------------------------------------------------------------------------------


def _hit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and benchmark items that share a seed, both as bases."""
    lines = V.dna_lines(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select("item_id", V.dna(F.col("text")).alias("ref"))
    pairs = align.sharing_seeds(lines.withColumn("seq", F.col("s")), items.withColumnRenamed("ref", "seq"), ["doc_id", "line", "s"], "item_id", CFG.seed_length)
    return pairs.join(items, "item_id")


@query()
def sw_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items aligned to the lines that share a seed with them, on both strands."""
    found = align.align_both_strands(align.dealt(_hit_lines(spark, sf_dir)), "ref", "s", CFG)
    return found.select("doc_id", "line", "item_id", "score", "ref_begin", "ref_end", "q_begin", "q_end", "cigar", "q_strand")


@query()
def aligned_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as virus segments, aligned to the benchmark items that they share a seed with as regions."""
    items = table(spark, sf_dir, "benchmark").select("item_id", V.dna(F.col("text")).alias("ref"))
    hits = materialize(_hit_lines(spark, sf_dir).drop("ref"), "hits")  # lines without a region aren't read again
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line").cast("string"))
    members = hits.select(F.col("item_id").alias("region_id"), name.alias("frag_id"))
    regions = items.select(F.col("item_id").alias("region_id"), F.lit(True).alias("is_virus"), F.col("ref").alias("seq"))
    return align.align_segments(members, regions, hits.select(name.alias("frag_id"), F.lit(True).alias("is_virus"), F.col("s").alias("seq")).distinct(), CFG)


@query()
def dup_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold benchmark text as calls: the line is one side, the item the other; an item's calls are compared."""
    hits = _hit_lines(spark, sf_dir)
    calls = hits.select(
        F.xxhash64("doc_id", "line", "item_id").alias("call_id"), F.lit("h0").alias("host_chr"), F.concat(F.lit("v"), F.col("item_id").cast("string")).alias("virus_chr"),
        F.lit(False).alias("host_rev"), F.lit(False).alias("virus_rev"), F.col("s").alias("host_seq"), F.col("ref").alias("virus_seq"),
    )
    return edgestats.duplicate_calls(calls, CFG)


@query()
def dust_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dust.dust_mask(V.dna_lines(spark, sf_dir), ["doc_id", "line"], "s")
