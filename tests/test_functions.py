"""Scalar functions against truth tables."""

import pytest
from pyspark.sql import functions as F

from junctura.functions import sequences as S


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("cigar", "length", "side", "left", "right"),
    [("50M", 50, 0, 0, 0), ("5S45M", 45, 1, 5, 0), ("45M5S", 45, 2, 0, 5), ("5S40M5S", 40, 3, 5, 5), ("10M2D10M", 22, 0, 0, 0), ("10M2I10M", 20, 0, 0, 0), ("5H45M", 45, 0, 0, 0)],
)
def test_cigar(spark, cigar, length, side, left, right):
    c = F.col("c")
    got = one(spark, F.array(S.reference_length(c), S.clip_side(c), S.left_clip(c), S.right_clip(c)), c=cigar)
    assert got == [length, side, left, right]


def test_collapse_and_full_length(spark):
    assert one(spark, S.collapse_matches(F.col("c")), c="3S5=2X4M1D3=") == "3S11M1D3M"
    assert one(spark, F.array(*[S.is_full_length(F.lit(c)) for c in ("10M", "5=5X", "5M5S", "5M1D5M")])) == [True, True, False, False]


def test_reverse_complement(spark):
    assert one(spark, S.reverse_complement(F.col("s")), s="acgtNxA") == "TNNACGT"


def test_split_strands(spark):
    table = {
        (True, "L", False): "++", (True, "L", True): "-+", (True, "R", False): "--", (True, "R", True): "+-",
        (False, "L", False): "--", (False, "L", True): "-+", (False, "R", False): "++", (False, "R", True): "+-",
    }
    df = spark.createDataFrame([(*k, v) for k, v in table.items()], "v boolean, side string, rev boolean, want string")
    host, virus = S.split_strands(F.col("v"), F.col("side"), F.col("rev"))
    assert df.where(F.concat(host, virus) != F.col("want")).count() == 0


def test_pair_strands_and_distance(spark):
    df = spark.createDataFrame([(False, False, "+-"), (False, True, "++"), (True, False, "--"), (True, True, "-+")], "h boolean, v boolean, want string")
    host, virus = S.pair_strands(F.col("h"), F.col("v"))
    assert df.where(F.concat(host, virus) != F.col("want")).count() == 0
    gaps = [one(spark, S.pair_distance(F.lit(True), F.lit(p), F.lit(2000))) for p in (1950, 1949, 3000, 3001)]
    assert gaps == [-50, None, 1000, None]


def test_alternatives(spark):
    got = one(spark, S.parse_alternatives(F.col("xa")), xa="c1,+11,10M,0;c2,-5,4S6M,2;")
    assert [tuple(r) for r in got] == [("c1", False, 10, "10M", 0), ("c2", True, 4, "4S6M", 2)]
    assert one(spark, S.supplementary_to_alternative(F.lit("c1,11,-,10M,60,3;"))) == "c1,-11,10M,3;"
    assert one(spark, F.array(S.alternative_count(F.lit("a;b;")), S.alternative_count(F.lit("")), S.alternative_count(F.lit(None).cast("string")))) == [3, 1, 1]


def test_complexity(spark):
    assert one(spark, F.array(*[S.is_homopolymer(F.lit(s)) for s in ("AAAAAAAAGC", "AAAAAAAGCT", "")])) == [True, False, False]
    low = [one(spark, S.is_low_complexity(F.lit(s), F.lit(0), F.lit(len(s)))) for s in ("ACACACACACACACACACAC", "ACGTTGCAAGCTTAGGCTCA")]
    assert low == [True, False]
    brute = "AAACAAGGT"
    rows = spark.createDataFrame([(brute_text, a, b) for brute_text, a, b in [("ACACGTNA", 0, 8), ("ACACGTNA", 2, 5), ("AAAA", -1, 4), ("", 0, 0), (None, 0, 3), ("ACGT", 3, 1), ("ACG", 0, 99)]], "s string, a int, b int")
    got = [r[0] for r in rows.select(S.top_dinucleotides(F.col("s"), F.col("a"), F.col("b"))).collect()]
    assert got == [2, 1, 3, 0, None, 0, 1]
    counts = one(spark, S.dinucleotide_counts(F.lit(brute)))
    assert counts == [sum(brute[i : i + 2] == a + b for i in range(len(brute) - 1)) for a in "ACGT" for b in "ACGT"]


def test_seeds(spark):
    k = one(spark, S.seed_keys(F.lit("AAACCCGGGTTTACGTGA")))
    assert [r["seed"] for r in k][:2] == ["CCCGGGTTTACGTGA", "AAAGGGTTTACGTGA"] and len(k) == 6
    assert len(one(spark, S.kmers(F.lit("ACG"), 4))) == 0


def test_small_helpers(spark):
    assert one(spark, S.trim_unknown(F.lit("NNACNGTN"))) == "ACNGT"
    assert one(spark, F.array(S.breakpoint_position(F.lit("-"), F.lit(5), F.lit(50), F.lit(7)), S.breakpoint_position(F.lit("+"), F.lit(5), F.lit(50), F.lit(7)))) == [43, 12]
    assert one(spark, F.array(S.distal(F.lit(True), F.lit(1), F.lit(9)), S.proximal(F.lit(True), F.lit(1), F.lit(9)))) == [9, 1]
    assert one(spark, F.array(S.has_one_segment(F.lit(64)), S.has_one_segment(F.lit(192)), S.has_one_segment(F.lit(0)))) == [True, False, False]
    assert one(spark, F.array(S.clip_sequence(F.lit("ABCDEFG"), F.lit("2S5M"), F.lit("L")), S.clip_sequence(F.lit("ABCDEFG"), F.lit("4M3S"), F.lit("R")))) == ["AB", "EFG"]


def test_clips_ask_no_regex_of_unclipped_cigars(spark):
    df = spark.createDataFrame([("40M",), ("3S40M",), ("40M2I7S",), ("5S30M6S",), ("0S9M",), ("4H9M",), ("9S",), ("",), ("2M3S4M",), (None,), ("99999999999S4M",)], "cigar string")
    got = [tuple(r) for r in df.select(S.left_clip(F.col("cigar")), S.right_clip(F.col("cigar")), S.clip_side(F.col("cigar"))).collect()]
    assert got == [(0, 0, 0), (3, 0, 1), (0, 7, 2), (5, 6, 3), (0, 0, 0), (0, 0, 0), (9, 9, 3), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    for c in (S.left_clip, S.right_clip):  # the regex is behind a condition
        assert "CASE WHEN" in df.select(c(F.col("cigar")))._jdf.queryExecution().optimizedPlan().toString()
