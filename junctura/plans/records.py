"""Queries over alignment records, alternatives, windows, call facts and files, with the SQL that states what each must return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.functions import sequences as S
from junctura.operators import calls as K
from junctura.operators import candidates as C
from junctura.operators import clean, edgeproc, ranges, records, screen, windows
from junctura.plans import queries as Q
from junctura.plans import views as V
from junctura.plans.queries import CFG, query
from junctura.plans.views import table
from junctura.sources import bam, readers, writers
from junctura.sources.shared import new_path

# -- records ----------------------------------------------------------------------------------------------------------

_FLAG = """1 + CASE WHEN seg = 1 THEN 64 ELSE 128 END + CASE WHEN rev THEN 16 ELSE 0 END + CASE WHEN nonprimary THEN 256 ELSE 0 END + CASE WHEN unmapped THEN 4 ELSE 0 END
    + CASE WHEN score % 2 = 0 THEN 32 ELSE 0 END + CASE WHEN score % 5 = 0 THEN 1024 ELSE 0 END + CASE WHEN score % 7 = 0 THEN 512 ELSE 0 END + CASE WHEN score % 13 = 0 THEN 2048 ELSE 0 END"""
REC = f"""{V.ALN}, rec AS (
    SELECT *, CAST({_FLAG} AS INTEGER) AS flag, {Q._CIGAR} AS cigar, CASE WHEN score % 3 = 0 THEN 'v0' ELSE chr END AS mate_chr, pos % 500 AS mate_pos, score * 5000 AS tlen FROM aln
)"""


def alignment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments with flags, CIGARs and mate fields."""
    aln = Q._cigar(V.alignments(spark, sf_dir))
    score = F.col("score")
    return aln.withColumns({
        "flag": F.expr(_FLAG).cast("int"), "mate_chr": F.when(score % 3 == 0, "v0").otherwise(F.col("chr")), "mate_pos": F.col("pos") % 500, "tlen": score * 5000,
    })


@query(f"""WITH {REC} SELECT read_id, seg, chr, pos, flag, (flag & 2304) = 0 AS first, (flag & 4) = 0 AS mapped, chr <> mate_chr OR abs(tlen) > 100000 AS discordant,
    ((flag & 64) <> 0) <> ((flag & 128) <> 0) AS one_segment, (flag & 1796) = 0 AS in_depth FROM rec""")
def flag_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("flag")
    return alignment_records(spark, sf_dir).select(
        "read_id", "seg", "chr", "pos", "flag", S.lacks_bits(flag, S.NOT_PRIMARY).alias("first"), (~S.has_flag(flag, "unmapped")).alias("mapped"),
        S.is_discordant(F.col("chr"), F.col("mate_chr"), F.col("tlen"), CFG.discordant_span).alias("discordant"), S.has_one_segment(flag).alias("one_segment"), S.lacks_bits(flag, S.NOT_IN_DEPTH).alias("in_depth"),
    )


@query(f"WITH {REC} SELECT read_id, seg, chr, pos, flag FROM rec WHERE (flag & 4) = 0 AND (chr <> mate_chr OR abs(tlen) > 100000)")
def discordant_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.discordant_rows(alignment_records(spark, sf_dir), CFG.discordant_span).select("read_id", "seg", "chr", "pos", "flag")


@query(f"WITH {REC} SELECT read_id, seg, chr, pos, flag FROM rec WHERE (flag & 2304) = 0 AND (flag & 1024) = 0")
def load_without_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.primary_rows(alignment_records(spark, sf_dir), duplicates=False).select("read_id", "seg", "chr", "pos", "flag")


@query(f"""WITH {REC} SELECT read_id, seg, chr, pos FROM rec
WHERE NOT (NOT is_virus AND score % 4 = 0) AND (flag & 1024) = 0""")
def screen_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth score stands for a read that matches from end to end."""
    plain = F.when(F.col("score") % 4 == 0, F.concat(F.col("rlen").cast("string"), F.lit("M"))).otherwise(F.col("cigar"))
    return records.worth_screening(alignment_records(spark, sf_dir).withColumn("cigar", plain)).select("read_id", "seg", "chr", "pos")


_ONE_EACH = "SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY read_id, seg ORDER BY score DESC, chr, pos, rev, rlen, left_clip, right_clip) = 1"


@query(f"""WITH {REC}, one AS ({_ONE_EACH}), j AS (SELECT a.*, b.chr AS o_chr, b.pos AS o_pos, b.rev AS o_rev, b.cigar AS o_cigar FROM one a JOIN one b ON a.read_id = b.read_id AND a.seg <> b.seg)
SELECT read_id, seg, CAST(((flag & ~32) | CASE WHEN o_rev THEN 32 ELSE 0 END) & ~2304 AS INTEGER) AS flag, chr, pos, o_chr AS mate_chr, o_pos AS mate_pos,
    CASE WHEN mate_chr = o_chr AND mate_pos = o_pos AND ((flag & 32) <> 0) = o_rev THEN tlen ELSE 0 END AS tlen, o_cigar AS mate_cigar,
    o_pos + (SELECT rlen FROM one c WHERE c.read_id = j.read_id AND c.seg <> j.seg) + 11 AS mate_end FROM j""")
def mate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = alignment_records(spark, sf_dir)
    # The flag ends ties that the SQL leaves open, so that runs agree with each other.
    order = [F.desc("score"), *[F.col(c) for c in ("chr", "pos", "rev", "rlen", "left_clip", "right_clip", "flag")]]
    told = records.with_mate_fields(clean.best_rows(rec, ["read_id", "seg"], order))
    return told.select("read_id", "seg", "flag", "chr", "pos", "mate_chr", "mate_pos", "tlen", "mate_cigar", S.end_position(F.col("mate_pos"), F.col("mate_cigar")).alias("mate_end"))


@query(f"""WITH {REC}, w AS (SELECT DISTINCT o_orderkey AS read_id, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 1 + o_custkey % 2 END AS seg FROM orders WHERE o_custkey % 5 = 0),
p AS (SELECT read_id, bool_or(seg IS NULL) AS paired FROM w GROUP BY read_id)
SELECT r.read_id, r.seg, r.chr, r.pos, CASE WHEN p.paired THEN CASE WHEN is_virus THEN 'V' ELSE 'H' END ELSE CAST(r.seg AS VARCHAR) END AS suffix
FROM rec r JOIN p USING (read_id) WHERE p.paired OR EXISTS (SELECT 1 FROM w WHERE w.read_id = r.read_id AND w.seg = r.seg)""")
def edge_read_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    wanted = table(spark, sf_dir, "orders").where(c % 5 == 0).select(F.col("o_orderkey").alias("read_id"), F.when(c % 3 != 0, (1 + c % 2).cast("int")).alias("seg"))
    return records.edge_segments(wanted, alignment_records(spark, sf_dir)).select("read_id", "seg", "chr", "pos", "suffix")


@query(f"""WITH {Q._CALLS}, r AS (SELECT host_chr AS chr, host_pos AS s, host_pos + 5 + call_id % 90 AS e FROM calls),
o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM r),
i AS (SELECT *, sum(n) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT chr, min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY chr, island HAVING count(*) >= 4""")
def sampling_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = Q._calls(spark, sf_dir)
    reads = calls.select(F.col("host_chr").alias("chr"), F.col("host_pos").alias("start"), (5 + F.col("call_id") % 90).alias("tlen"))
    return records.sampling_regions(reads, least=4)


@query()
def random_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many places as there are lines, on contigs as long as the documents."""
    docs = table(spark, sf_dir, "documents")
    return records.random_positions(docs.select(F.col("doc_id").cast("string").alias("chr"), F.length("text").cast("long").alias("len")), docs.count(), seed=7)


# -- sequences of reads -----------------------------------------------------------------------------------------------


@query(f"""WITH {V.DNA_LINES}, c AS (SELECT *, 3 + doc_id % 9 AS l, line % 4 AS r, length(s) AS n, doc_id % 2 = 0 AS rev FROM dna_lines WHERE length(s) >= 30)
SELECT doc_id, line, substring(s, 1, l) AS left_clip, CASE WHEN r > 0 THEN substring(s, n - r + 1, r) ELSE '' END AS right_clip,
    CASE WHEN rev THEN translate(reverse(s), 'ACGT', 'TGCA') ELSE s END AS as_read, CASE WHEN rev THEN reverse(replace(s, 'A', 'I')) ELSE replace(s, 'A', 'I') END AS qual,
    round(list_sum(list_transform(string_split(substring(replace(s, 'A', 'I'), CAST(l + 1 AS BIGINT), CAST(n - l - r AS BIGINT)), ''), lambda x: ascii(x) - 33)) / (n - l - r), 6) AS mean_quality FROM c""")
def read_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips, orientation and quality of lines as reads; their letters, A as I, serve as qualities."""
    s, rev = F.col("s"), F.col("doc_id") % 2 == 0
    left, right = (3 + F.col("doc_id") % 9), F.col("line") % 4
    middle = F.concat(left.cast("string"), F.lit("S"), (F.length(s) - left - right).cast("string"), F.lit("M"))
    cigar = F.when(right > 0, F.concat(middle, right.cast("string"), F.lit("S"))).otherwise(middle)
    reads = V.dna_lines(spark, sf_dir).where(F.length(s) >= 30).withColumn("cigar", cigar).withColumn("q", F.replace(s, F.lit("A"), F.lit("I")))
    return reads.select(
        "doc_id", "line", S.clip_sequence(s, F.col("cigar"), F.lit("L")).alias("left_clip"), S.clip_sequence(s, F.col("cigar"), F.lit("R")).alias("right_clip"), S.oriented(s, rev).alias("as_read"),
        S.oriented_qualities(F.col("q"), rev).alias("qual"), F.round(S.mean_quality(F.col("q"), F.col("cigar")), 6).alias("mean_quality"),
    )


@query(f"""WITH {REC} SELECT read_id, seg, chr || ',' || CASE WHEN rev THEN '-' ELSE '+' END || (pos + 1) || ',' || cigar || ',' || score || ';' AS own, 1 + score % 3 AS x2,
    'v0,+' || (pos + 9) || ',' || cigar || ',3;' AS from_sa, left_clip >= 5 AS left_clipped, right_clip >= 5 AS right_clipped FROM rec""")
def alternative_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = alignment_records(spark, sf_dir)
    own = S.alternative_text(F.col("chr"), F.col("rev"), F.col("pos"), F.col("cigar"), F.col("score"))
    sa = F.concat_ws(",", F.lit("v0"), (F.col("pos") + 9).cast("string"), F.lit("+"), F.col("cigar"), F.lit("60"), F.lit("3"))
    return rec.withColumn("own", own).select("read_id", "seg", "own", S.alternative_count(F.expr("repeat(own, score % 3)")).alias("x2"), S.supplementary_to_alternative(F.concat(sa, F.lit(";"))).alias("from_sa"), *[S.is_clipped(F.col("cigar"), e, CFG.min_clip_length).alias(n) for e, n in (("L", "left_clipped"), ("R", "right_clipped"))])


@query(f"""WITH {V.ALN}, u AS (SELECT DISTINCT read_id, seg, chr, rev, pos FROM aln UNION SELECT DISTINCT read_id, seg, chr, NOT rev, pos + 7 FROM aln)
SELECT read_id, seg, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM u GROUP BY ALL""")
def merged_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of all rows' alternatives of a segment: each row's own place and one more."""
    aln = V.alignments(spark, sf_dir)
    text = F.concat(*[S.alternative_text(F.col("chr"), r, F.col("pos") + k, F.lit("20M"), F.lit(0)) for r, k in ((F.col("rev"), 0), (~F.col("rev"), 7))])
    union = clean.merged_alternatives(aln.withColumn("alts", S.parse_alternatives(text)))
    return union.select("read_id", "seg", F.size("alts").cast("long").alias("n"), F.aggregate("alts", F.lit(0).cast("long"), lambda a, x: a + x["pos"]).alias("places"))


_TWO_ALTS = """own AS (SELECT read_id, seg, is_virus, chr, pos, rev, rlen, score FROM best),
alts AS (
    SELECT read_id, seg, is_virus AS own_virus, chr, pos, pos + rlen AS e, rev FROM own
    UNION SELECT read_id, seg, is_virus, CASE WHEN score % 10 = 0 THEN CASE WHEN is_virus THEN 'h1' ELSE 'v0' END ELSE chr END, pos + 7, pos + 7 + rlen, NOT rev FROM own
    UNION SELECT read_id, seg, is_virus, chr, pos + 13, pos + 13 + rlen, rev FROM own
)"""


def _segments_with_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = V.best(V.alignments(spark, sf_dir))
    cigar = F.concat(F.col("rlen").cast("string"), F.lit("M"))
    other = F.when(F.col("score") % 10 == 0, F.when(F.col("is_virus"), "h1").otherwise("v0")).otherwise(F.col("chr"))
    xa = F.concat(S.alternative_text(other, ~F.col("rev"), F.col("pos") + 7, cigar, F.lit(1)), S.alternative_text(F.col("chr"), F.col("rev"), F.col("pos") + 13, cigar, F.lit(2)))
    return best.withColumn("cigar", cigar).withColumn("alts", S.parse_alternatives(xa))


def _contigs(spark: SparkSession) -> DataFrame:
    return V.listed(spark, [("h0", False), ("h1", False), ("v0", True)], "chr", "is_virus")


@query(f"""WITH {V.BEST}, {_TWO_ALTS}, good AS (
    SELECT read_id FROM alts GROUP BY read_id HAVING count(DISTINCT seg) = 2 AND count(DISTINCT own_virus) = 2 AND bool_and(own_virus = (chr = 'v0'))
), crossed AS (
    SELECT h.read_id, h.chr AS h_chr, h.e AS h_pos, h.rev AS h_rev, v.chr AS v_chr, v.pos AS v_pos, v.rev AS v_rev
    FROM alts h JOIN alts v ON h.read_id = v.read_id AND NOT h.own_virus AND v.own_virus SEMI JOIN good ON h.read_id = good.read_id
)
SELECT h_chr AS chr, h_pos AS pos, CASE WHEN h_rev THEN '-' ELSE '+' END AS strand, read_id AS frag_id, false AS is_virus FROM crossed
UNION SELECT v_chr, v_pos, CASE WHEN v_rev THEN '+' ELSE '-' END, read_id, true FROM crossed""")
def alt_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every alternative of one mate with every one of the other; one in ten has one on the wrong organism."""
    return C.alternative_pair_candidates(_segments_with_alternatives(spark, sf_dir), _contigs(spark))


@query(f"""WITH {V.BEST}, {_TWO_ALTS}, {Q._CLIPS}, a AS (
    SELECT c.read_id, c.seg, c.side, c.anchor_is_virus, t.chr, t.pos, t.e FROM clips c JOIN alts t USING (read_id, seg) WHERE t.own_virus = (t.chr = 'v0')
), k AS (
    SELECT c.read_id, c.seg, c.side, t.chr AS c_chr, t.pos AS c_pos, t.e AS c_end, t.rev AS c_rev FROM clips c JOIN alts t ON t.read_id = c.read_id AND t.seg <> c.seg WHERE (t.chr = 'v0') <> c.anchor_is_virus
), crossed AS (
    SELECT a.*, c_chr, c_pos, c_end, c_rev, {Q._SPLIT.replace("rev", "c_rev")} FROM a JOIN k USING (read_id, seg, side)
)
SELECT chr, CASE WHEN side = 'L' THEN pos ELSE e END AS pos, CASE WHEN anchor_is_virus THEN virus_strand ELSE host_strand END AS strand, read_id AS frag_id, chr = 'v0' AS is_virus, seg FROM crossed
UNION SELECT c_chr, CASE WHEN side = 'L' THEN c_end ELSE c_pos END, CASE WHEN anchor_is_virus THEN host_strand ELSE virus_strand END, read_id, c_chr = 'v0', seg FROM crossed""")
def alt_split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of clipped reads; the mate's places serve as the clip's."""
    rows = _segments_with_alternatives(spark, sf_dir)
    clips = C.extract_clips(rows.drop("alts"), CFG.min_clip_size).select("read_id", "seg", "side")
    anchors = rows.join(clips, ["read_id", "seg"])
    mates = rows.withColumn("seg", 3 - F.col("seg")).join(clips, ["read_id", "seg"])
    return C.alternative_split_candidates(anchors, mates, _contigs(spark))


@query(f"""WITH {REC}, r AS (SELECT *, CASE WHEN left_clip > 0 THEN 1 WHEN right_clip > 0 THEN 2 ELSE 0 END AS side FROM rec)
SELECT read_id, seg, chr, pos, score % 6 = 0 AS ruled_out, CAST(CASE WHEN score % 6 <> 0 AND (left_clip >= 20) <> (right_clip >= 20) THEN 1 ELSE 0 END AS INTEGER) AS clips FROM r""")
def clips_with_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with a full-length alternative yield no clip; every sixth score has one."""
    rec = alignment_records(spark, sf_dir).withColumn("row", F.monotonically_increasing_id())
    alt = F.array(F.struct(F.when(F.col("score") % 6 == 0, "30M4=2X").otherwise("30M6S").alias("cigar")))
    rec = Q.materialize(rec.withColumn("alts", alt), "rec")
    clips = C.extract_clips(rec, CFG.min_clip_size).select("row", F.lit(1).alias("c"))
    out = rec.join(clips, "row", "left")
    return out.select("read_id", "seg", "chr", "pos", (F.col("score") % 6 == 0).alias("ruled_out"), F.coalesce("c", F.lit(0)).alias("clips"))


# -- CIGARs of both sides ---------------------------------------------------------------------------------------------


@query(f"""WITH {REC}, j AS (SELECT read_id, seg, chr, pos, score, (rlen || 'M4S') AS h, CASE WHEN score % 2 = 0 THEN '7S' ELSE '' END || '5=' || score || 'X2D9M' AS v FROM rec)
SELECT read_id, seg, chr, pos, CASE WHEN score % 3 = 0 THEN '4S' || regexp_extract(h, '^(\\d+)M', 1) || 'M' ELSE regexp_extract(h, '^(\\d+)M', 1) || 'M1S' END AS head,
    CASE WHEN score % 2 = 0 THEN '1S' ELSE '' END || (5 + score) || 'M2D9M' AS tail FROM j""")
def joint_cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint CIGARs, cut at the junction for comparison: the clip next to it counts one, runs of matches are one."""
    rec, score = alignment_records(spark, sf_dir), F.col("score")
    h = F.concat(F.col("rlen").cast("string"), F.lit("M4S"))
    v = F.concat(F.when(score % 2 == 0, "7S").otherwise(""), F.lit("5="), score.cast("string"), F.lit("X2D9M"))
    host = S.joint_cigar(h, F.lit("1D"), score % 3 == 0, F.lit(False))
    virus = S.joint_cigar(F.lit("1D"), v, F.lit(False), F.lit(False))
    return rec.select("read_id", "seg", "chr", "pos", F.regexp_replace(host, "1D$", "").alias("head"), F.regexp_replace(virus, "^1D", "").alias("tail"))


@query(f"""WITH {REC}, t AS (SELECT *, rlen || 'M' || (1 + score % 3) || 'D' AS a, (rlen + read_id % 2) || 'M' || (1 + score % 4) || CASE WHEN read_id % 3 = 0 THEN 'I' ELSE 'D' END AS b,
    (1 + score % 4) || 'M2I' || rlen || 'M' AS c, (1 + score % 3) || CASE WHEN read_id % 5 = 0 THEN 'D' ELSE 'M' END || '2I' || (rlen + read_id % 2) || 'M' AS d FROM rec)
SELECT read_id, seg, chr, pos, regexp_extract(a, '^\\d+M') = regexp_extract(b, '^\\d+M') AND right(a, 1) = right(b, 1) AS front,
    regexp_extract(c, '2I\\d+M$') = regexp_extract(d, '2I\\d+M$') AND regexp_extract(c, '^\\d+(.)', 1) = regexp_extract(d, '^\\d+(.)', 1) AS back FROM t""")
def cigar_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIGARs made of each row's numbers, two by two: lengths or operations of some differ."""
    rec = alignment_records(spark, sf_dir)
    score, rlen, odd = F.col("score"), F.col("rlen"), F.col("rlen") + F.col("read_id") % 2

    def cigar(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    a, b = cigar(rlen, "M", 1 + score % 3, "D"), cigar(odd, "M", 1 + score % 4, F.when(F.col("read_id") % 3 == 0, "I").otherwise("D"))
    c, d = cigar(1 + score % 4, "M2I", rlen, "M"), cigar(1 + score % 3, F.when(F.col("read_id") % 5 == 0, "D").otherwise("M"), "2I", odd, "M")
    return rec.select("read_id", "seg", "chr", "pos", S.consistent_cigars(a, b, F.lit(False)).alias("front"), S.consistent_cigars(c, d, F.lit(True)).alias("back"))


@query(f"""WITH {V.DNA_LINES}, g AS (SELECT *, doc_id % 7 AS o FROM dna_lines WHERE length(s) >= 12)
SELECT doc_id, line, substring(repeat('N', CAST(o AS BIGINT)) || substring(s, 3, 4) || '--' || substring(s, 7, 3) || repeat('N', 20), 1, 14) AS gapped,
    substring(s, 1, 6) = substring(s, 7, 6) AS same, regexp_replace(repeat('N', CAST(o AS BIGINT)) || substring(s, 3, 4) || 'NN', '^N+|N+$', '', 'g') AS trimmed FROM g""")
def gapped_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, o = F.col("s"), (F.col("doc_id") % 7).cast("int")
    rows = V.dna_lines(spark, sf_dir).where(F.length(s) >= 12)
    return rows.select(
        "doc_id", "line", S.gapped_sequence(s, o, F.lit(14), F.lit("2S4M2D3I")).alias("gapped"), S.consistent_sequences(F.substring(s, 1, 6), F.substring(s, 7, 6)).alias("same"),
        S.trim_unknown(F.concat(F.repeat(F.lit("N"), o), F.substring(s, 3, 4), F.lit("NN"))).alias("trimmed"),
    )


def _top2(text: str) -> str:
    pairs = f"list_transform(range(1, length({text})), lambda i: substring({text}, i, 2))"
    counts = ", ".join(f"len(list_filter({pairs}, lambda x: x = '{a}{b}'))" for a in "ACGT" for b in "ACGT")
    return f"list_sum(list_reverse_sort([{counts}])[1:2])"


@query(f"""WITH {V.DNA_LINES}, r AS (
    SELECT doc_id, line, length(s) AS n, line % 7 AS qb, length(s) - 1 - doc_id % 5 AS qe, doc_id % 11 AS rb, length(s) - 1 AS re, CAST(doc_id % 17 AS INTEGER) AS clip, CAST(line % 29 AS INTEGER) AS bp, s, reverse(s) AS ref
    FROM dna_lines
), t AS (
    SELECT *, substring(s, CAST(qb + 2 AS BIGINT), CAST(greatest(qe - qb - 1, 0) AS BIGINT)) AS q1, substring(ref, CAST(rb + 2 AS BIGINT), CAST(greatest(re - rb - 1, 0) AS BIGINT)) AS r1 FROM r
), u AS (
    SELECT *, {_top2("q1")} >= 0.75 * (qe - qb + 1) OR {_top2("r1")} >= 0.75 * (re - rb + 1) AS low FROM t
)
SELECT doc_id, line FROM u WHERE NOT low AND NOT (clip > 10 AND abs(bp - re) > 10) AND NOT (clip > 10 AND abs(bp - rb) > 10)""")
def suspicious_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as reads, reversed as regions; what is left once those that look wrong on either side are gone."""
    s = F.col("s")
    lines = V.dna_lines(spark, sf_dir)
    clip = (F.col("doc_id") % 17).cast("string")
    facts = {
        "seq": s, "q_begin": F.col("line") % 7, "q_end": (F.length(s) - 1 - F.col("doc_id") % 5).cast("int"), "ref": F.reverse(s), "begin": (F.col("doc_id") % 11).cast("int"), "end": F.length(s) - 1,
        "bp": F.col("line") % 29,
    }
    reads = lines.select("doc_id", "line", *[c.alias(f"{side}_{n}") for side in "hv" for n, c in facts.items()], F.concat(F.lit("9M"), clip, F.lit("S")).alias("h_cigar"), F.concat(clip, F.lit("S9M")).alias("v_cigar"))
    return edgeproc.without_suspicious(reads, CFG).select("doc_id", "line")


# -- windows ----------------------------------------------------------------------------------------------------------


def _text_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chr"), V.dna(F.col("text")).alias("seq"))


@query(f"""WITH c AS (SELECT 'd' || doc_id AS chr, {V.DNA.format("text")} AS s, length({V.DNA.format("text")}) AS n, doc_id FROM documents),
w AS (SELECT *, CAST(greatest(n // 3 - 150, 0) AS BIGINT) AS a, CAST(least(n // 3 + 350, n) AS BIGINT) AS b, CASE WHEN doc_id % 2 = 0 THEN '-' ELSE '+' END AS strand FROM c WHERE n > 0)
SELECT chr, a AS start, b AS "end", strand, CASE WHEN strand = '-' THEN translate(reverse(substring(s, a + 1, b - a)), 'ACGT', 'TGCA') ELSE substring(s, a + 1, b - a) END AS seq FROM w""")
def region_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as contigs in rows of 128 bases; the middle third's surroundings as regions, both sides of an edge."""
    contigs = Q.materialize(_text_contigs(spark, sf_dir), "contigs")
    n = F.length("seq").cast("long")
    lengths = contigs.select("chr", n.alias("len"))
    odd = F.substring("chr", 2, 20).cast("long") % 2 == 0
    third = F.expr("length(seq) div 3")
    names = {"chr": F.col("chr"), "strand": F.when(odd, "-").otherwise("+"), "left": third + 50, "right": third + 150}
    edges = contigs.where(n > 0).select(*[c.alias(f"{s}_{k}") for s in "hv" for k, c in names.items()])
    found = windows.region_sequences(windows.region_windows(edges, lengths, 200), windows.contig_chunks(contigs, 128), 128)
    return found.select("chr", "start", "end", "strand", "seq")


_CALL_SPANS = f"""{Q._CALLS}, spans AS (
    SELECT call_id, host_chr, host_rev, host_pos % 1000 AS hs, host_pos % 1000 + 40 AS he, split_reads = 0 AS virus_rev, host_len AS vs, host_len + 40 AS ve FROM calls
), win AS (
    SELECT call_id, false AS is_virus, host_chr AS chr, greatest(hs - CASE WHEN host_rev THEN 0 ELSE 500 END, 0) AS w_start, least(he + CASE WHEN host_rev THEN 500 ELSE 0 END, 1050) AS w_end FROM spans
    UNION ALL SELECT call_id, true, 'v0', greatest(vs - CASE WHEN virus_rev THEN 500 ELSE 0 END, 0), least(ve + CASE WHEN virus_rev THEN 0 ELSE 500 END, 500) FROM spans
)"""


def _call_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = Q._calls(spark, sf_dir)
    at = F.col("host_pos") % 1000
    spans = calls.select("call_id", "host_chr", "host_rev", at.alias("host_start"), (at + 40).alias("host_end"), F.lit("v0").alias("virus_chr"), (F.col("split_reads") == 0).alias("virus_rev"), F.col("host_len").alias("virus_start"), (F.col("host_len") + 40).alias("virus_end"))
    lengths = V.listed(spark, [("h0", 1050), ("h1", 1050), ("v0", 500)], "chr", "len").select("chr", F.col("len").cast("long").alias("len"))
    return windows.coverage_windows(spans, lengths, CFG.max_is)


@query(f"WITH {_CALL_SPANS} SELECT * FROM win")
def coverage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _call_windows(spark, sf_dir)


_LONG = 5_000_000
_DEPTH = f"""{_CALL_SPANS}, long AS (SELECT call_id, is_virus, chr, w_start + call_id * 7919 % {_LONG} AS w_start, w_end + call_id * 7919 % {_LONG} AS w_end FROM win), {REC},
p AS (SELECT DISTINCT chr, unnest(range(far, far + rlen)) AS p FROM (SELECT *, pos + read_id * 104729 % {_LONG} AS far FROM rec) WHERE (flag & 1796) = 0),
cov AS (SELECT call_id, is_virus, count(p.p) AS covered, CASE WHEN w_end > w_start THEN count(p.p) / (w_end - w_start) ELSE 0.0 END AS share FROM long LEFT JOIN p ON long.chr = p.chr AND p.p >= w_start AND p.p < w_end GROUP BY call_id, is_virus, w_start, w_end)"""


def _depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads and windows, spread over contigs that are long enough to leave something uncovered."""
    apart = F.col("call_id") * 7919 % _LONG
    wide = _call_windows(spark, sf_dir).withColumns({"w_start": F.col("w_start") + apart, "w_end": F.col("w_end") + apart})
    return windows.depth_share(wide, alignment_records(spark, sf_dir).withColumn("pos", F.col("pos") + F.col("read_id") * 104729 % _LONG))


@query(f"WITH {_DEPTH} SELECT call_id, is_virus, covered, round(share, 6) AS share FROM cov")
def depth_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of reads that count."""
    return _depth(spark, sf_dir).select("call_id", "is_virus", "covered", F.round("share", 6).alias("share"))


@query(f"""WITH {_DEPTH} SELECT call_id, round(greatest(c.host_cov, coalesce(h.share, 0)), 6) AS host_cov, round(greatest(c.virus_cov, coalesce(v.share, 0)), 6) AS virus_cov
FROM calls c LEFT JOIN cov h USING (call_id) LEFT JOIN cov v USING (call_id) WHERE NOT h.is_virus AND v.is_virus""")
def adjusted_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = K.adjust_coverage(Q._calls(spark, sf_dir), windows.measured_coverage(_depth(spark, sf_dir)))
    return calls.select("call_id", F.round("host_cov", 6).alias("host_cov"), F.round("virus_cov", 6).alias("virus_cov"))


# -- facts of calls ---------------------------------------------------------------------------------------------------

_MASKS = f"""{Q._CALLS}, masks AS (
    SELECT call_id, 'host' AS side, host_len % 40 AS s, host_len % 40 + host_masked AS e FROM calls WHERE call_id % 3 > 0
    UNION ALL SELECT call_id, 'virus', virus_len % 30, virus_len % 30 + 20 FROM calls WHERE call_id % 4 > 0
    UNION ALL SELECT call_id, 'virus', virus_len % 30 + 10, virus_len % 30 + 10 + virus_masked FROM calls WHERE call_id % 4 > 1
), m AS (
    SELECT call_id, side, count(DISTINCT p) AS masked FROM (SELECT call_id, side, unnest(range(s, e)) AS p FROM masks) GROUP BY ALL
)"""


def _mask_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, i = Q._calls(spark, sf_dir), F.col("call_id")
    h, v = F.col("host_len") % 40, F.col("virus_len") % 30

    def rows(keep, side: str, start, end, order: int) -> DataFrame:
        return calls.where(keep).select("call_id", F.lit(side).alias("side"), start.alias("start"), end.alias("end"), F.lit(order).alias("ord"))

    return ranges.union_all(
        rows(i % 3 > 0, "host", h, h + F.col("host_masked"), 0), rows(i % 4 > 0, "virus", v, v + 20, 0), rows(i % 4 > 1, "virus", v + 10, v + 10 + F.col("virus_masked"), 1)
    )


@query(f"""WITH {_MASKS}, f AS (
    SELECT c.* EXCLUDE (host_masked, virus_masked), coalesce(h.masked, 0) AS host_masked, coalesce(v.masked, 0) AS virus_masked
    FROM calls c LEFT JOIN m h ON h.call_id = c.call_id AND h.side = 'host' LEFT JOIN m v ON v.call_id = c.call_id AND v.side = 'virus'
)
SELECT call_id, host_len, virus_len, host_masked, virus_masked, {Q._ACCEPT} AS accepted FROM f""")
def call_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with the lengths of their sequences and what of these is masked, and whether that lets them pass."""
    calls = Q._calls(spark, sf_dir)
    sides = [calls.select("call_id", F.lit(s).alias("side"), F.repeat(F.lit("A"), F.col(f"{s}_len").cast("int")).alias("seq")) for s in ("host", "virus")]
    bare = calls.drop("host_len", "virus_len", "host_masked", "virus_masked")
    facts = K.with_sequences_and_masks(bare, sides[0].unionByName(sides[1]), _mask_rows(spark, sf_dir))
    return K.accept_calls(facts, CFG).select("call_id", "host_len", "virus_len", "host_masked", "virus_masked", "accepted")


@query(f"""WITH {_MASKS} SELECT call_id, side, max_by(s, e) AS start, max(e) AS "end" FROM (
    SELECT *, row_number() OVER (PARTITION BY call_id, side ORDER BY n DESC) AS r FROM (SELECT *, CASE WHEN s >= 10 + virus_len % 30 AND side = 'virus' THEN 1 ELSE 0 END AS n FROM masks JOIN calls USING (call_id))
) WHERE r = 1 GROUP BY call_id, side""")
def last_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.last_masks(_mask_rows(spark, sf_dir))


@query(f"""WITH {Q._CALLS}, a AS (SELECT *, {Q._ACCEPT} AS accepted, call_id % 7 = 0 AS removed FROM calls)
SELECT call_id, true AS accepted FROM a WHERE accepted AND NOT removed UNION ALL SELECT call_id, false FROM a WHERE NOT accepted AND NOT removed""")
def call_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = K.accept_calls(Q._calls(spark, sf_dir), CFG).withColumn("removed", F.col("call_id") % 7 == 0)
    return K.reported(calls).select("call_id", "accepted").unionByName(K.reported(calls, rejected=True).select("call_id", "accepted"))


_ENTRIES = f"""{V.EDGES}, {Q._EDGE_ALN}, e AS (
    SELECT *, h_chr || h_left || v_left || h_strand || v_strand || frag_id AS frag, frag_id % 2 = 0 AS h_turned, frag_id % 3 = 0 AS v_turned FROM edge_aln
), both_sides AS (
    SELECT *, h_turned <> (h_strand = '-') AS h_rev, v_turned <> (v_strand = '-') AS v_rev, CASE WHEN h_strand = '-' THEN h_left + 2000 - h_end - 1 ELSE h_left + h_begin END AS h_pos,
        CASE WHEN v_strand = '-' THEN v_left + 2000 - v_end - 1 ELSE v_left + v_begin END AS v_pos FROM e
)"""


def _entry_sql(me: str, mate: str, bit: int) -> str:
    return f"""SELECT frag AS frag_id, {"true" if me == "v" else "false"} AS is_virus, CAST(1 + {bit} + CASE WHEN {me}_rev THEN 16 ELSE 0 END + CASE WHEN {mate}_rev THEN 32 ELSE 0 END AS INTEGER) AS flag, {me}_chr AS chr, {me}_pos AS pos,
        CASE WHEN {me}_strand = '-' THEN '5S' || {me}_len || '=' ELSE {me}_len || '=5S' END AS cigar, {mate}_chr AS mate_chr, {mate}_pos AS mate_pos, CASE WHEN {me}_rev THEN 'AACGT' ELSE 'ACGTT' END AS seq FROM both_sides"""


@query(f"WITH {_ENTRIES} {_entry_sql('h', 'v', 64)} UNION ALL {_entry_sql('v', 'h', 128)}")
def call_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every edge's reads on both sides, as they are written for a call."""
    reads = Q._edge_alignments(spark, sf_dir)
    name = F.concat(*[F.col(c).cast("string") for c in ("h_chr", "h_left", "v_left", "h_strand", "v_strand", "frag_id")])
    facts = {}
    for side, by in (("h", 2), ("v", 3)):
        facts |= {f"{side}_cigar": F.concat(F.col(f"{side}_len").cast("string"), F.lit("=5S")), f"{side}_q_strand": F.when(F.col("frag_id") % by == 0, "-").otherwise("+"), f"{side}_seq": F.lit("ACGTT")}
    rows = reads.withColumns(facts).withColumn("frag_id", name).withColumns({"h_len": F.lit(2000), "v_len": F.lit(2000)})
    return records.alignment_entries(rows)


@query(f"WITH {V.EDGES} SELECT {Q._E}, CASE WHEN h_strand = '-' THEN h_right - 3 ELSE h_left + 3 END AS h_at, CASE WHEN v_strand = '-' THEN v_right - 5 ELSE v_left + 5 END AS v_at FROM edges")
def breakpoint_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Q._edge_reads(spark, sf_dir).select(*V.EDGE).distinct()
    at = {s: S.breakpoint_position(F.col(f"{s}_strand"), F.col(f"{s}_left"), F.col(f"{s}_right"), F.lit(k)) for s, k in (("h", 3), ("v", 5))}
    return e.select("*", at["h"].alias("h_at"), at["v"].alias("v_at"))


@query(f"""WITH {V.EDGES}, o AS (SELECT {Q._E}, n_reads FROM edges ORDER BY n_reads DESC, {Q._E} LIMIT 100) SELECT * FROM o""")
def top_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best-supported edges: the order in which edges are gone through."""
    return Q.edge_support(spark, sf_dir).orderBy(F.desc("n_reads"), *V.EDGE).limit(100)


# -- files ------------------------------------------------------------------------------------------------------------


def _first_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("read_id"), V.dna(F.col("text")).alias("s")).where("s <> ''")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mates for each document: its letters as bases, and the same read backwards."""
    return _mates(_first_mates(spark, sf_dir))


def _mates(docs: DataFrame) -> DataFrame:
    mates = F.array(F.struct(F.lit(1).alias("seg"), F.col("s").alias("seq")), F.struct(F.lit(2).alias("seg"), F.reverse("s").alias("seq")))
    return docs.select("ord", "read_id", F.inline(mates)).withColumn("qual", F.translate("seq", "ACGT", "I5+?"))


_READS = f"""reads AS (SELECT 'r' || doc_id AS read_id, {V.DNA.format("text")} AS s FROM documents WHERE {V.DNA.format("text")} <> '')"""


@query(f"""WITH {_READS} SELECT read_id, CAST(1 AS INTEGER) AS seg, s AS seq, translate(s, 'ACGT', 'I5+?') AS qual FROM reads
UNION ALL SELECT read_id, CAST(2 AS INTEGER), reverse(s), translate(reverse(s), 'ACGT', 'I5+?') FROM reads""")
def fastq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read pairs written to two sets of files and read back in lock-step."""
    first, path = Q.materialize(_first_mates(spark, sf_dir), "reads"), new_path(spark, "fastq")
    reads = _mates(first.orderBy("ord"))  # what is told by the letters is made behind the sort
    for seg in (1, 2):
        writers.write_fastq(reads, f"{path}_{seg}", seg, "gzip", in_order=True)
    return readers.read_fastq_pairs(spark, f"{path}_1", f"{path}_2").select("read_id", "seg", "seq", "qual")


@query(f"""WITH {_READS} SELECT read_id, s AS seq FROM reads ORDER BY CAST(substring(read_id, 2) AS BIGINT) LIMIT 100""")
def fastq_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred records of a file: the sample from which insert sizes are taken."""
    path = new_path(spark, "fastq")
    writers.write_fastq(_reads(spark, sf_dir), path, 1)
    return readers.sample_pairs(readers.read_fastq(spark, path), 100).select("read_id", "seq")


@query(f"""WITH c AS (SELECT 'd' || doc_id AS chr, {V.DNA.format("text")} AS seq FROM documents) SELECT chr, seq, length(seq) AS len FROM c""")
def fasta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "fasta")
    writers.write_fasta(_text_contigs(spark, sf_dir), "chr", "seq", path)
    return readers.read_fasta(spark, path)


@query(f"""WITH c AS (SELECT 'd' || doc_id AS chr, {V.DNA.format("text")} AS s FROM documents),
k AS (SELECT chr, s, CAST(unnest(range(greatest((length(s) + 999) // 1000, 1))) AS BIGINT) AS chunk FROM c)
SELECT chr, chunk, substring(s, chunk * 1000 + 1, 1000) AS part FROM k""")
def fasta_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as contigs in lines of 60 letters, read back as rows of 1,000 bases that no line's end meets."""
    path = new_path(spark, "fasta-lines")
    writers.write_fasta(_text_contigs(spark, sf_dir), "chr", "seq", path, 60)
    return readers.read_fasta_chunks(spark, path, 1000)


@query(f"""WITH b AS (SELECT 'h' || doc_id AS name, false AS is_virus, {V.DNA.format("text")} AS s FROM documents UNION ALL SELECT 'v' || item_id, true, {V.DNA.format("text")} FROM benchmark)
SELECT name AS chr, CAST(row_number() OVER (ORDER BY is_virus, name) AS INTEGER) AS contig_id, length(s) AS len, is_virus FROM b""")
def contig_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "references")
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        rows = table(spark, sf_dir, name).select(F.concat(F.lit("h" if name == "documents" else "v"), F.col(key).cast("string")).alias("chr"), F.lower(V.dna(F.col("text"))).alias("seq"))
        writers.write_fasta(rows, "chr", "seq", f"{path}-{name}")
    return readers.contig_catalog(spark, f"{path}-documents", f"{path}-benchmark")


@query(f"""WITH {_READS} SELECT 'Reg_' || read_id AS region, 'h0' AS chr, length(s) AS "left", length(s) + 60 AS "right", CASE WHEN length(s) % 2 = 0 THEN '+' ELSE '-' END AS strand, s AS seq FROM reads""")
def region_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, n, path = _reads(spark, sf_dir).where("seg = 1"), F.length("seq"), new_path(spark, "regions")
    name = F.concat(F.lit("Reg_"), F.col("read_id"), F.lit("::h0:"), n.cast("string"), F.lit("-"), (n + 60).cast("string"), F.when(n % 2 == 0, "(+)").otherwise("(-)"))
    writers.write_fasta(reads.withColumn("name", name), "name", "seq", path)
    return readers.read_region_sequences(spark, path)


@query(f"""WITH {_READS}, k AS (SELECT read_id, s, CAST(substring(read_id, 2) AS BIGINT) % 3 AS kind FROM reads)
SELECT read_id AS frag_id, false AS is_split, s AS host_seq, reverse(s) AS virus_seq, NULL AS mate_frag_id FROM k WHERE kind = 0
UNION ALL SELECT read_id || '_1', true, s, s, read_id || '_2' FROM k WHERE kind = 1 UNION ALL SELECT read_id || '_2', true, reverse(s), reverse(s), read_id || '_1' FROM k WHERE kind = 1
UNION ALL SELECT read_id || '_1', true, s, s, NULL FROM k WHERE kind = 2""")
def edge_read_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of edges: pairs, split reads with both mates, and split reads with one."""
    kind, path = F.col("ord") % 3, new_path(spark, "edge-reads")
    end = F.when(kind == 0, F.when(F.col("seg") == 1, "_H").otherwise("_V")).otherwise(F.concat(F.lit("_"), F.col("seg").cast("string")))
    reads = _reads(spark, sf_dir).where((kind < 2) | (F.col("seg") == 1)).withColumn("name", F.concat(F.col("read_id"), end))
    writers.write_fasta(reads, "name", "seq", path)
    return readers.read_edge_reads(spark, path)


@query(f"""WITH {V.CAND} SELECT chr, pos AS start, pos + 1 AS "end", CAST(frag_id AS VARCHAR) AS name, strand FROM cand""")
def bed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates written as BED lines and read back."""
    path = new_path(spark, "candidates")
    cand = V.candidates(spark, sf_dir)
    writers.write_bed(cand.select("chr", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.col("frag_id").cast("string").alias("name"), "strand"), path)
    return readers.read_bed(spark, path).select("chr", "start", "end", "name", "strand")


@query(f"WITH {V.REGIONS} SELECT DISTINCT CAST(frag_id AS VARCHAR) AS frag_id, chr || ':' || strand || ':' || \"left\" AS region_id FROM members")
def region_map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "region-map")
    _, members = V.regions(V.candidates(spark, sf_dir))
    name = F.concat_ws(":", "chr", "strand", F.col("left").cast("string"))
    writers.write_tsv(members.select(F.col("frag_id").cast("string").alias("frag_id"), name.alias("region_id")).distinct(), path, "frag_id", "region_id")
    return readers.read_region_map(spark, path)


@query(f"WITH {V.EDGES} SELECT {Q._E}, CAST(frag_id AS VARCHAR) AS frag_id FROM edge_reads")
def edge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "edges")
    writers.write_edges(Q._edge_reads(spark, sf_dir), path)
    return readers.read_edges(spark, path)


@query(f"""WITH {REC} SELECT CAST(read_id AS VARCHAR) AS read_id, CAST(seg AS INTEGER) AS seg, flag, chr, pos, rev, cigar, mate_chr, mate_pos, tlen, score AS as_score, CASE WHEN score % 2 = 0 THEN 'v0,+' || (pos + 1) || ',20M,1;' END AS xa FROM rec""")
def sam_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "sam")
    rec, score = alignment_records(spark, sf_dir), F.col("score").cast("string")
    tags = F.concat_ws("\t", F.concat(F.lit("AS:i:"), score), F.when(F.col("score") % 2 == 0, F.concat(F.lit("XA:Z:v0,+"), (F.col("pos") + 1).cast("string"), F.lit(",20M,1;"))))
    writers.write_sam(rec.withColumns({"mapq": F.lit(60), "seq": F.lit("ACGT"), "qual": F.lit("IIII"), "tags": tags}), path, "chr", "pos")
    return readers.read_sam(spark, path).select("read_id", "seg", "flag", "chr", "pos", "rev", "cigar", "mate_chr", "mate_pos", "tlen", "as_score", "xa")


def _bam(spark: SparkSession, sf_dir: str) -> str:
    path, rec = new_path(spark, "bam"), alignment_records(spark, sf_dir)
    facts = {"read_id": F.col("read_id").cast("string"), "mapq": F.lit(60), "seq": F.lit("ACGT"), "qual": F.lit("IIII"), "as_score": F.col("score"), "xa": F.when(F.col("score") % 2 == 0, F.concat(F.lit("v0,+"), (F.col("pos") + 1).cast("string"), F.lit(",20M,1;")))}
    bam.write_bam(rec.withColumns(facts), [("h0", 1050), ("h1", 1050), ("v0", 500)], path)
    return path


@query(f"""WITH {REC} SELECT CAST(read_id AS VARCHAR) AS read_id, CAST(seg AS INTEGER) AS seg, flag, chr, pos, rev, cigar, mate_chr, mate_pos, tlen, score AS as_score, CASE WHEN score % 2 = 0 THEN 'v0,+' || (pos + 1) || ',20M,1;' END AS xa, 'ACGT' AS seq, 'IIII' AS qual FROM rec""")
def bam_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments written as BAM and read back in splits of 100 kB."""
    return bam.read_bam(spark, _bam(spark, sf_dir), split=100_000).select("read_id", "seg", "flag", "chr", "pos", "rev", "cigar", "mate_chr", "mate_pos", "tlen", "as_score", "xa", "seq", "qual")


@query(f"WITH {REC} SELECT CAST(read_id AS VARCHAR) AS read_id, CAST(seg AS INTEGER) AS seg, pos, flag FROM rec WHERE chr = 'h1' AND pos < 600 AND pos + rlen + 11 > 400")
def bam_region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies over a stretch of one contig, by the files' index."""
    return bam.read_bam(spark, _bam(spark, sf_dir), contig="h1", first=400, last=600).select("read_id", "seg", "pos", "flag")


@query(f"WITH {REC} SELECT read_id, seg, pos, flag FROM rec WHERE chr = 'h1'")
def contig_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contig of alignments that lie in a folder for each."""
    path = new_path(spark, "by-contig")
    writers.write_by_contig(alignment_records(spark, sf_dir), path)
    return spark.read.parquet(path).where("chr = 'h1'").select("read_id", "seg", "pos", "flag")


@query(f"WITH {REC} SELECT DISTINCT CAST(read_id AS VARCHAR) AS read_id FROM rec WHERE (flag & 1024) = 0")
def name_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "names")
    writers.write_names(alignment_records(spark, sf_dir).where(~S.has_flag(F.col("flag"), "duplicate")), path)
    return spark.read.text(path).toDF("read_id")


@query(f"WITH {REC} SELECT CAST(read_id % 20 AS INTEGER) AS call_id, chr, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM rec GROUP BY ALL")
def call_read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments of each call in a folder of its own; twenty calls by read id."""
    path = new_path(spark, "call-reads")
    writers.write_call_reads(alignment_records(spark, sf_dir).withColumn("call_id", F.col("read_id") % 20), path)
    return spark.read.parquet(path).groupBy("call_id", "chr").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


@query(f"""WITH {_MASKS} SELECT call_id, CASE WHEN side = 'host' THEN 'L' ELSE 'R' END AS side, s AS start, e AS "end" FROM masks""")
def mask_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "masks")
    name = F.concat(F.col("call_id").cast("string"), F.when(F.col("side") == "host", "_L").otherwise("_R"))
    writers.write_tsv(_mask_rows(spark, sf_dir).select(name.alias("name"), "start", "end"), path)
    return readers.read_masks(spark, path)


@query(f"""WITH {Q._CALLS} SELECT call_id, host_chr, host_rev, host_pos AS host_start, host_pos + 10 AS host_end, CAST(good_pairs AS INTEGER) AS good_pairs, CAST(split_reads AS INTEGER) AS split_reads,
    round(host_pbs, 6) AS host_pbs, round(host_cov, 6) AS host_cov, round(virus_cov, 6) AS virus_cov FROM calls""")
def call_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw call lines written and read back."""
    path = new_path(spark, "calls")
    writers.write_lines(Q.format_calls(spark, sf_dir), F.col("raw"), path)
    read = readers.read_calls(spark, path)
    return read.select("call_id", "host_chr", "host_rev", "host_start", "host_end", "good_pairs", "split_reads", *[F.round(c, 6).alias(c) for c in ("host_pbs", "host_cov", "virus_cov")])
