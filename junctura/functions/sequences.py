"""Column functions on sequences, CIGARs and alternative-alignment strings; all but one run inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BASE_CODES = np.full(256, 4, np.int64)
_BASE_CODES[list(b"ACGT\n")] = [0, 1, 2, 3, 5]

#: CIGAR operations that use up reference, query, or only the query's ends.
ON_REFERENCE, CLIPS = "MDN=X", "SH"


def reverse_complement(s: Column) -> Column:
    """The other strand, read forwards; letters other than A, C, G, T become N."""
    return F.translate(F.reverse(F.regexp_replace(F.upper(s), "[^ACGT]", "N")), "ACGT", "TGCA")


def oriented(s: Column, reverse: Column) -> Column:
    """A read as it was sequenced: the other strand where the alignment is reversed."""
    return F.when(reverse, reverse_complement(s)).otherwise(s)


def oriented_qualities(qual: Column, reverse: Column) -> Column:
    """Qualities in the order in which the read was sequenced."""
    return F.when(reverse, F.reverse(qual)).otherwise(qual)


def mean_quality(qual: Column, cigar: Column) -> Column:
    """Mean base quality (characters from ``!`` on) of the part of a read that isn't soft-clipped; null if nothing is left."""
    inner = F.substring(qual, left_clip(cigar) + 1, F.length(qual) - left_clip(cigar) - right_clip(cigar))
    letters = F.filter(F.split(inner, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda acc, c: acc + F.ascii(c) - 33) / F.nullif(F.size(letters), F.lit(0))


def kmers(s: Column, k: int) -> Column:
    """Array of the k-mers at every position, in order; empty for shorter texts. Null gives null."""
    # One pass of the regex engine: a lookahead matches at each position without using it up.
    return F.regexp_extract_all(s, F.lit(rf"(?s)(?<![\x{{D800}}-\x{{DBFF}}])(?=(.{{{k}}}))"), F.lit(1))


def seed_keys(kmer: Column, k: int = 18, block: int = 3) -> Column:
    """Array of ``(mask, seed)``: the k-mer without its block number ``mask``, for every block."""
    return F.array(*[
        F.struct(F.lit(m).alias("mask"), F.concat(F.substring(kmer, 1, m * block), F.substring(kmer, (m + 1) * block + 1, k)).alias("seed"))
        for m in range(k // block)
    ])


def letter_count(s: Column, letter: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def max_base_count(s: Column) -> Column:
    """How often the most frequent of A, C, G, T occurs."""
    return F.greatest(*[letter_count(s, b) for b in "ACGT"])


def is_homopolymer(s: Column, share: float = 0.8) -> Column:
    """Whether one base makes up ``share`` of the sequence; false for an empty one."""
    return F.coalesce(max_base_count(s) >= F.lit(share) * F.length(s), F.lit(False)) & (F.length(s) > 0)


def dinucleotide_counts(s: Column) -> Column:
    """Counts of the 16 dinucleotides, overlaps included, by string lengths alone.

    Lambdas bind the sequence once and keep the generated code small, wherever and however often this is used.
    """
    pairs = F.array(*[F.lit(a + b) for a in "ACGT" for b in "ACGT"])
    bound = F.array(F.struct(s.alias("s"), F.regexp_replace(s, r"(.)\1+", "$1").alias("runs")))

    def counts(t: Column) -> Column:
        def less(of: Column, without: Column) -> Column:
            return F.length(of) - F.length(F.replace(of, without, F.lit("")))

        def one(pair: Column) -> Column:
            letter = F.substring(pair, 1, 1)
            # A run of n letters has n - 1; collapsed, it counts one.
            in_runs = less(t["s"], letter) - less(t["runs"], letter)
            return F.when(letter == F.substring(pair, 2, 1), in_runs).otherwise((less(t["s"], pair) / 2).cast("int"))

        return F.transform(pairs, one)

    return F.transform(bound, counts)[0]


def top_dinucleotides(s: Column, start: Column, end: Column) -> Column:
    """The summed counts of the two most frequent dinucleotides of the stretch from start + 1 to ``end``, exclusive.

    Counted by numpy for an Arrow batch of rows at a time: sixteen string replacements a row cost many times that.
    """
    return F.pandas_udf(_top_two, "int")(s, start.cast("int"), end.cast("int"))


def _top_two(s: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    known = (s.notna() & start.notna() & end.notna()).to_numpy()
    parts = [t[int(a) + 1 : max(int(b), int(a) + 1)] for t, a, b in zip(s[known], start[known], end[known], strict=True)]
    code = _BASE_CODES[np.frombuffer("\n".join([*parts, ""]).encode("ascii", "replace"), np.uint8)]
    row = np.cumsum(code == 5)[:-1]
    pair = (code[:-1] < 4) & (code[1:] < 4)
    counts = np.bincount(row[pair] * 16 + code[:-1][pair] * 4 + code[1:][pair], minlength=16 * len(parts)).reshape(-1, 16)
    top = np.sort(counts, axis=1)[:, -2:].sum(1)
    out = pd.Series([None] * len(s), dtype="Int32")
    out[known] = top.astype(np.int32)
    return out


def is_low_complexity(s: Column, start: Column, end: Column, share: float = 0.75) -> Column:
    """Whether two dinucleotides make up ``share`` of the stretch; the divisor counts both ends."""
    return top_dinucleotides(s, start, end) >= F.lit(share) * (end - start + 1)


# -- CIGAR ------------------------------------------------------------------------------------------------------------


def cigar_parts(cigar: Column) -> Column:
    """Array of ``(n, op)``."""
    found = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(found, lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("n"), F.substring(p, -1, 1).alias("op")))


def reference_length(cigar: Column) -> Column:
    """Bases of reference that an alignment spans."""
    runs = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ON_REFERENCE}]"), F.lit(1))
    return F.aggregate(runs, F.lit(0), lambda acc, n: acc + n.cast("int"))


def query_length(cigar: Column) -> Column:
    """Bases of the read that an alignment accounts for, soft clips included."""
    runs = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIS=X]"), F.lit(1))
    return F.aggregate(runs, F.lit(0), lambda acc, n: acc + n.cast("int"))


def end_position(pos: Column, cigar: Column) -> Column:
    return pos + reference_length(cigar)


def left_clip(cigar: Column) -> Column:
    """Soft-clipped bases at the left end, 0 without."""
    # Most CIGARs are settled without a regex.
    return F.when(F.contains(cigar, F.lit("S")), F.coalesce(F.regexp_extract(cigar, r"^(\d+)S", 1).try_cast("int"), F.lit(0))).otherwise(0)


def right_clip(cigar: Column) -> Column:
    return F.when(F.endswith(cigar, F.lit("S")), F.coalesce(F.regexp_extract(cigar, r"(\d+)S$", 1).try_cast("int"), F.lit(0))).otherwise(0)


def clip_side(cigar: Column) -> Column:
    """0 no soft clip, 1 left, 2 right, 3 both."""
    return F.when(left_clip(cigar) > 0, 1).otherwise(0) + F.when(right_clip(cigar) > 0, 2).otherwise(0)


def is_clipped(cigar: Column, side: str, least: int = 5) -> Column:
    """Whether a read is soft-clipped by ``least`` bases or more at the end ``'L'`` or ``'R'``."""
    return (left_clip(cigar) if side == "L" else right_clip(cigar)) >= least


def is_full_length(cigar: Column) -> Column:
    """Whether all operations are M, = or X."""
    return cigar.rlike(r"^(\d+[M=X])+$")


def collapse_matches(cigar: Column) -> Column:
    """``=`` and ``X`` as M, neighbouring runs joined."""
    plain = F.translate(cigar, "=X", "MM")
    groups = F.regexp_extract_all(plain, F.lit(r"((?:\d+M)+|\d+[^M\d])"), F.lit(1))

    def joined(g: Column) -> Column:
        total = F.aggregate(F.split(F.regexp_replace(g, "M$", ""), "M"), F.lit(0), lambda acc, n: acc + n.cast("int"))
        return F.when(g.rlike(r"M\d"), F.concat(total.cast("string"), F.lit("M"))).otherwise(g)

    return F.when(plain.rlike(r"M\d+M"), F.array_join(F.transform(groups, joined), "")).otherwise(plain)


def operations(cigar: Column) -> Column:
    """Array of a CIGAR's operations as text, such as ``12M``."""
    return F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))


def joint_cigar(host: Column, virus: Column, host_reversed: Column, virus_reversed: Column) -> Column:
    """Both alignments of a fragment as one CIGAR, through the junction: a soft clip next to it counts one base."""
    h, v = (F.when(r, F.reverse(operations(c))).otherwise(operations(c)) for c, r in ((host, host_reversed), (virus, virus_reversed)))
    last, first = F.try_element_at(h, F.lit(-1)), F.try_element_at(v, F.lit(1))
    h = F.when(last.endswith("S"), F.concat(F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), F.array(F.lit("1S")))).otherwise(h)
    v = F.when(first.endswith("S"), F.concat(F.array(F.lit("1S")), F.slice(v, F.lit(2), F.size(v)))).otherwise(v)
    return collapse_matches(F.concat(F.array_join(h, ""), F.array_join(v, "")))


def consistent_cigars(a: Column, b: Column, from_back: Column) -> Column:
    """Whether two CIGARs agree from one end on: as many operations, all equal but for the length of the last."""
    x, y = (F.when(from_back, F.reverse(operations(c))).otherwise(operations(c)) for c in (a, b))
    n = F.size(x)
    but_last = F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0))) == F.slice(y, F.lit(1), F.greatest(n - 1, F.lit(0)))
    kind = F.right(F.try_element_at(x, F.lit(-1)), F.lit(1)) == F.right(F.try_element_at(y, F.lit(-1)), F.lit(1))
    return (n == F.size(y)) & ((n == 0) | (but_last & F.coalesce(kind, F.lit(False))))


def gapped_sequence(seq: Column, offset: Column, width: Column, cigar: Column) -> Column:
    """A read laid over its reference of ``width`` bases from ``offset`` on: N where it says nothing, ``-`` for deleted
    bases; inserted bases take places like matched ones, and what goes beyond the reference is cut."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, p: Column) -> Column:
        n, op = p["n"], p["op"]
        piece = F.when(op.isin("M", "=", "X", "I"), F.substring(seq, acc["at"] + 1, n)).when(op == "D", F.repeat(F.lit("-"), n)).otherwise("")
        used = F.when(op.isin("M", "=", "X", "I", "S", "H"), n).otherwise(0)
        return F.struct(F.concat(acc["out"], piece).alias("out"), (acc["at"] + used).alias("at"))

    laid = F.aggregate(cigar_parts(cigar), state, step)["out"]
    return F.rpad(F.concat(F.repeat(F.lit("N"), offset), laid), width, "N")


def consistent_sequences(a: Column, b: Column) -> Column:
    """Whether two sequences of one length agree wherever neither has N."""
    places = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))

    def differs(p: Column) -> Column:
        x, y = F.substring(a, p, F.lit(1)), F.substring(b, p, F.lit(1))
        return (x != y) & (x != "N") & (y != "N")

    return (F.length(a) == F.length(b)) & ~F.exists(places, differs)


def clip_sequence(seq: Column, cigar: Column, side: Column) -> Column:
    """The clipped bases of a side, ``'L'`` or ``'R'``."""
    return F.when(side == "L", F.left(seq, left_clip(cigar))).otherwise(F.right(seq, right_clip(cigar)))


# -- alternative alignments -------------------------------------------------------------------------------------------


def items(s: Column, separator: str) -> Column:
    """The non-empty parts of a delimited string; null gives none."""
    return F.filter(F.split(F.coalesce(s, F.lit("")), separator), lambda x: x != "")


def parse_alternatives(xa: Column) -> Column:
    """Array of ``(chr, rev, pos, cigar, nm)`` from ``chr,±pos,cigar,nm;...``; positions become 0-based."""

    def one(item: Column) -> Column:
        f = F.split(item, ",")
        return F.struct(
            f[0].alias("chr"), F.startswith(f[1], F.lit("-")).alias("rev"), (F.abs(f[1].cast("bigint")) - 1).alias("pos"), f[2].alias("cigar"), f[3].cast("int").alias("nm")
        )

    return F.transform(items(xa, ";"), one)


def supplementary_to_alternative(sa: Column) -> Column:
    """``chr,pos,strand,cigar,mapq,nm;...`` in the form of alternative alignments."""

    def one(item: Column) -> Column:
        f = F.split(item, ",")
        return F.concat_ws(",", f[0], F.concat(f[2], f[1]), f[3], f[5])

    return F.array_join(F.transform(items(sa, ";"), lambda x: F.concat(one(x), F.lit(";"))), "")


def alternative_text(chrom: Column, rev: Column, pos: Column, cigar: Column, nm: Column) -> Column:
    """One alignment as an alternative; ``pos`` 0-based."""
    return F.concat(F.concat_ws(",", chrom, F.concat(F.when(rev, "-").otherwise("+"), (pos + 1).cast("string")), cigar, nm.cast("string")), F.lit(";"))


def alternative_count(xa: Column) -> Column:
    """An alignment and its alternatives."""
    return F.lit(1) + F.size(items(xa, ";"))


# -- orientation and intervals ----------------------------------------------------------------------------------------


def strand(rev: Column) -> Column:
    return F.when(rev, "-").otherwise("+")


def pair_strands(host_rev: Column, virus_rev: Column) -> tuple[Column, Column]:
    """Strands of a junction that the two mates of a pair span: (host, virus)."""
    return F.when(host_rev, "-").otherwise("+"), F.when(virus_rev, "+").otherwise("-")


def split_strands(anchor_is_virus: Column, side: Column, clip_rev: Column) -> tuple[Column, Column]:
    """Strands of a junction inside a read: (host, virus). The anchor's end fixes its own, the clip's turn the other."""
    own_plus = (side == "L") == anchor_is_virus
    other_plus = F.when(side == "L", clip_rev == F.lit(False)).otherwise(clip_rev)
    other_plus = F.when(anchor_is_virus, other_plus).otherwise(~other_plus)
    host = F.when(anchor_is_virus, other_plus).otherwise(own_plus)
    virus = F.when(anchor_is_virus, own_plus).otherwise(other_plus)
    return F.when(host, "+").otherwise("-"), F.when(virus, "+").otherwise("-")


def pair_distance(first_rev: Column, first_pos: Column, second_pos: Column, low: int = -50, high: int = 1000) -> Column:
    """Signed gap between two breakpoints, the reversed one behind; null outside the band."""
    gap = F.when(first_rev, first_pos - second_pos).otherwise(second_pos - first_pos)
    return F.when(gap.between(low, high), gap)


def breakpoint_position(strand_col: Column, left: Column, right: Column, offset: Column) -> Column:
    """Where an offset into a region's sequence lies on its contig."""
    return F.when(strand_col == "-", right - offset).otherwise(left + offset)


def distal(is_virus: Column, ref_begin: Column, ref_end: Column) -> Column:
    """The end of an alignment that lies away from the junction, whatever the strands."""
    return F.when(is_virus, ref_end).otherwise(ref_begin)


def proximal(is_virus: Column, ref_begin: Column, ref_end: Column) -> Column:
    return F.when(is_virus, ref_begin).otherwise(ref_end)


def slop(start: Column, end: Column, by: Column, length: Column) -> tuple[Column, Column]:
    """An interval widened on both sides within its contig."""
    return F.greatest(start - by, F.lit(0)), F.least(end + by, length)


def strand_slop(start: Column, end: Column, strand_col: Column, upstream: Column, downstream: Column, length: Column) -> tuple[Column, Column]:
    """An interval widened along its own strand, within its contig: on ``-`` upstream is to the right."""
    minus = strand_col == "-"
    left, right = F.when(minus, downstream).otherwise(upstream), F.when(minus, upstream).otherwise(downstream)
    return F.greatest(start - left, F.lit(0)), F.least(end + right, length)


def trim_unknown(s: Column) -> Column:
    """Without N at either end."""
    return F.regexp_replace(s, "^N+|N+$", "")


# -- flags ------------------------------------------------------------------------------------------------------------

FLAG_BITS = {"paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "read1": 64, "read2": 128, "secondary": 256, "qc_fail": 512, "duplicate": 1024, "supplementary": 2048}


def has_flag(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(F.lit(FLAG_BITS[name])) != 0


def lacks_bits(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) == 0


#: Bits of rows that coverage leaves out: unmapped, secondary, failed quality checks, duplicate.
NOT_IN_DEPTH = 4 + 256 + 512 + 1024
#: Bits of rows that are not a read's first alignment: secondary, supplementary.
NOT_PRIMARY = 256 + 2048


def is_discordant(chrom: Column, mate_chrom: Column, tlen: Column, span: int = 100_000) -> Column:
    """Whether a read's mate lies on another contig or further away than ``span``."""
    return (chrom != mate_chrom) | (F.abs(tlen) > span)


def with_flag(flag: Column, name: str, value: Column) -> Column:
    """``flag`` with one bit set or cleared."""
    bit = FLAG_BITS[name]
    return F.when(value, flag.bitwiseOR(F.lit(bit))).otherwise(flag.bitwiseAND(F.lit(~bit)))


def has_one_segment(flag: Column) -> Column:
    """Whether exactly one of the read1 and read2 bits is set."""
    return has_flag(flag, "read1") != has_flag(flag, "read2")
