"""Alignment records, duplicates, windows and seeds against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.config import JunctionConfig
from junctura.functions import sequences as S
from junctura.operators import align, calls, containment, dust, edgeproc, edges, ranges, records, screen, windows
from junctura.plans import views as V

CFG = JunctionConfig()


def ops(cigar):
    return [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]


def text(parts):
    return "".join(f"{n}{o}" for n, o in parts)


def plain_joint(h, v, h_rev, v_rev):
    h, v = (ops(c)[::-1] if r else ops(c) for c, r in ((h, h_rev), (v, v_rev)))
    if h and h[-1][1] == "S":
        h[-1] = (1, "S")
    if v and v[0][1] == "S":
        v[0] = (1, "S")
    out = []
    for n, o in h + v:
        o = "M" if o in "=X" else o
        if out and o == "M" and out[-1][1] == "M":
            out[-1] = (out[-1][0] + n, "M")
        else:
            out.append((n, o))
    return text(out)


def plain_consistent(a, b, back):
    x, y = (ops(c)[::-1] if back else ops(c) for c in (a, b))
    return len(x) == len(y) and (not x or (x[:-1] == y[:-1] and x[-1][1] == y[-1][1]))


def plain_gapped(seq, offset, width, cigar):
    out, at = "N" * offset, 0
    for n, o in ops(cigar):
        if o in "M=XI":
            out += seq[at : at + n]
        elif o == "D":
            out += "-" * n
        at += n if o in "M=XISH" else 0
    return (out + "N" * width)[:width]


def random_cigar(rng):
    return text([(rng.randint(1, 3), o) for o in rng.choice(["M", "=X=", "S=", "=S", "MDM", "=IX", "SMS", "MM=", "X"])])


def test_cigar_functions(spark):
    rng = random.Random(1)
    rows = [(random_cigar(rng), random_cigar(rng), rng.random() < 0.5, rng.random() < 0.5, "".join(rng.choices("ACGT", k=9)), rng.randint(0, 4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "h string, v string, hr boolean, vr boolean, s string, o int")
    got = df.select(
        "*", S.joint_cigar(F.col("h"), F.col("v"), F.col("hr"), F.col("vr")).alias("joint"), S.consistent_cigars(F.col("h"), F.col("v"), F.col("hr")).alias("same"),
        S.gapped_sequence(F.col("s"), F.col("o"), F.lit(8), F.col("h")).alias("gapped"), S.query_length(F.col("h")).alias("ql"), S.reference_length(F.col("h")).alias("rl"), S.collapse_matches(F.concat("h", "v")).alias("collapsed"),
    ).collect()
    for r in got:
        assert r.joint == plain_joint(r.h, r.v, r.hr, r.vr)
        assert r.same == plain_consistent(r.h, r.v, r.hr)
        assert r.gapped == plain_gapped(r.s, r.o, 8, r.h)
        assert r.ql == sum(n for n, o in ops(r.h) if o in "MIS=X") and r.rl == sum(n for n, o in ops(r.h) if o in "MDN=X")
        if "S" not in r.h + r.v:
            assert r.collapsed == plain_joint(r.h + r.v, "", False, False)


@pytest.mark.parametrize("limit", [200_000, 0])
@pytest.mark.parametrize("exploratory", [False, True])
def test_duplicates_one_by_one(spark, monkeypatch, limit, exploratory):
    monkeypatch.setattr(edgeproc, "DEDUP_ROWS", limit)  # 0: every edge goes by rounds
    rng = random.Random(2)
    rows = [(e, f, rng.randint(0, 9), rng.randint(0, 9), rng.choice(["4M", "5M", "4M1D", "3M2S"])) for e in range(3) for f in range(25)]
    rows += [(9, k, k // 2, (k + 1) // 2, "4M") for k in range(30)]  # a staircase: each shares an end with the next
    df = spark.createDataFrame(rows, "edge int, frag_id int, h_distal int, v_distal int, joint string")
    got = {(r.edge, r.frag_id) for r in edgeproc.remove_duplicates(df, ["edge"], exploratory).collect()}
    want = set()
    for e in {r[0] for r in rows}:
        kept = []
        for _, f, h, v, c in sorted(r for r in rows if r[0] == e):
            on_h, on_v = [k for k in kept if k[0] == h], [k for k in kept if k[1] == v]
            if on_h and on_v:
                continue
            if on_h or on_v:
                if not exploratory or any(plain_consistent(k[2], c, not on_h) for k in on_h or on_v):
                    continue
            kept.append((h, v, c))
            want.add((e, f))
    assert got == want


def dust_by_definition(s, window, threshold):
    def score(a, b):
        found = Counter(s[i : i + 3] for i in range(a, b - 2))
        return sum(c * (c - 1) // 2 for c in found.values()) / (b - a - 3) if b - a > 3 else 0

    scores = {(a, b): score(a, b) for a in range(len(s) - 2) for b in range(a + 3, min(len(s), a + window) + 1)}
    covered = set()
    for (a, b), x in scores.items():
        if x > threshold and all(scores[c, d] <= x for c in range(a, b - 2) for d in range(c + 3, b + 1)):
            covered |= set(range(a, b))
    return covered


def test_dust_by_definition():
    rng = random.Random(3)
    seqs = ["".join(rng.choice(["A" * rng.randint(1, 9), "AC" * rng.randint(1, 5), rng.choice("ACGTN"), "ACG" * rng.randint(1, 4)]) for _ in range(rng.randint(0, 8)))[:36] for _ in range(20)]
    found = dust.dust_spans_of(seqs, 20)
    assert [{k for a, b in spans for k in range(a, b)} for spans in found] == [dust_by_definition(s, 20, 2.0) for s in seqs]
    assert all(b < c for spans in found for (_, b), (c, _) in zip(spans[:-1], spans[1:], strict=True))


def test_seed_hits_by_lookup_and_by_join(spark):
    rng = random.Random(4)
    ref = "".join(rng.choices("ACGT", k=300))
    reads = []
    for i in range(40):
        at = rng.randint(0, 240)
        s = list(ref[at : at + 50]) if i % 2 else rng.choices("ACGT", k=50)
        for _ in range(rng.randint(0, 4)):
            s[rng.randrange(50)] = rng.choice("ACGT")
        reads.append((i, "".join(s)))
    df = spark.createDataFrame([*reads, (90, None), (91, ""), (92, "ACGT"), (93, "é" * 30)], "id int, seq string")
    index = screen.seed_index(spark.createDataFrame([(ref,)], "seq string"), CFG)
    both = [{r.id: r.hits for r in screen.seed_hits(df, index, CFG, ["id"], small=small).collect()} for small in (10**6, 0)]
    assert both[0] == both[1] and len(both[0]) > 15
    seeds = {(m, k[: 3 * m] + k[3 * m + 3 :]) for t in (ref, ref[::-1].translate(str.maketrans("ACGT", "TGCA"))) for k in (t[p : p + 18] for p in range(len(t) - 17)) for m in range(6)}
    plain = {i: sum(any((m, s[p : p + 3 * m] + s[p + 3 * m + 3 : p + 18]) in seeds for m in range(6)) for p in range(len(s) - 17)) for i, s in reads}
    assert both[0] == {i: n for i, n in plain.items() if n}


def test_seeds_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With a hash that tells nothing apart, the letters alone decide."""
    monkeypatch.setattr(screen, "_spread", lambda sums, mask: sums * np.uint64(0) + np.uint64(7))
    rng = random.Random(12)
    ref, other = ("".join(rng.choices("ACGT", k=40)) for _ in range(2))
    index = screen.seed_index(spark.createDataFrame([(ref,)], "seq string"), CFG)
    known = index.toPandas()
    keys = np.full(len(known), 7, np.uint64)
    letters = np.array([[m, *map(ord, s)] for m, s in zip(known["mask"], known["seed"], strict=True)], np.uint8)
    table = np.ones(1 << 22, dtype=bool)
    hits = [screen._hit_places(np.array(list(map(ord, t)), np.uint64), keys, letters, table, 6, 3) for t in (ref, other, ref[:18] + other[:5])]
    assert hits == [23, 0, 4]  # three more whose last block is masked


def test_places_do_not_depend_on_partitions(spark):
    contigs = spark.createDataFrame([(f"c{k:03}", 1 + k * k % 97) for k in range(200)] + [("huge", 30_000), ("none", 0), ("null", None)], "chr string, len long")
    found = []
    for n in (1, 7):
        drawn = records.random_positions(contigs.repartition(n), 20_000, seed=3)
        assert "NestedLoop" not in drawn._jdf.queryExecution().toString()
        found.append(sorted(map(tuple, drawn.collect())))
    assert found[0] == found[1] and len(found[0]) == 20_000
    total = 30_000 + sum(1 + k * k % 97 for k in range(200))
    lengths = {r.chr: r.len for r in contigs.collect() if r.len}
    seen = Counter(c for c, _ in found[0])
    assert set(seen) <= set(lengths) and all(0 <= p < lengths[c] for c, p in found[0])
    halves = Counter(p // 3000 for c, p in found[0] if c == "huge")
    chi = sum((seen[c] - 20_000 * n / total) ** 2 / (20_000 * n / total) for c, n in lengths.items())
    assert chi < 300  # 200 degrees of freedom: 1 in 200,000
    assert sum((n - seen["huge"] / 10) ** 2 / (seen["huge"] / 10) for n in halves.values()) < 35


def test_islands_of_one_contig_are_spread(spark):
    rng = random.Random(5)
    spans = sorted((a, a + rng.choice([0, 5, 40, 900])) for a in (rng.randint(0, 5_000) for _ in range(300)))
    df = spark.createDataFrame([(k, "c", a, b) for k, (a, b) in enumerate(spans)] + [(999, None, 1, 2)], "id int, chr string, s long, e long")
    numbered = ranges.islands(df, ["chr"], "s", "e", width=256)
    got = {r.id: r.island for r in numbered.collect()}
    want, number, reach = {}, 0, None
    for k, (a, b) in sorted(enumerate(spans), key=lambda x: (x[1], x[0])):
        if reach is None or a > reach:
            number += 1
        reach = b if reach is None else max(reach, b)
        want[k] = number
    assert got.pop(999) == 1 and got == want
    union = {(r.s, r.e) for r in ranges.merged(df.where("id < 999"), ["chr"], "s", "e", width=256).collect()}
    lows, highs = {}, {}
    for k, (a, b) in enumerate(spans):
        lows[want[k]] = min(a, lows.get(want[k], a))
        highs[want[k]] = max(b, highs.get(want[k], b))
    assert union == {(lows[n], highs[n]) for n in lows}
    # All rows lie on one contig; the windows are still dealt by contig and bin, so many tasks have rows.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    binned = df.withColumn("b", F.floor(F.col("s") / 256)).repartition(8, "chr", "b")
    assert binned.select(F.spark_partition_id()).distinct().count() > 3
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nearest_mates_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), rng.random() < 0.5, rng.randint(0, 30_000)) for i in range(400)] + [(900, "a", None, 5), (901, "a", True, None)]
    df = spark.createDataFrame(rows, "call_id long, host_chr string, host_rev boolean, host_pos long")
    got = {(r.call_id, r.mate_id, r.dist) for r in calls.nearest_mates(df, CFG).collect()}
    want = set()
    for i, c, rev, p in rows[:400]:
        near = [(abs(d), j, d) for j, c2, r2, q in rows[:400] if c2 == c and r2 != rev and -50 <= (d := p - q if rev else q - p) <= 1000]
        if near:
            _, j, d = min(near)
            want.add((i, j, d))
    assert got == want


def test_nearest_mates_of_many_calls_at_a_place(spark):
    """Frames that reach to the end of a bin are gone through anew for each row; a bin holds each place once."""
    df = spark.range(20_000).select("id", (F.col("id") % 3 == 0).alias("host_rev"), (F.col("id") % 7 * 40).alias("host_pos"))
    df = df.select(F.col("id").alias("call_id"), F.lit("a").alias("host_chr"), "host_rev", "host_pos").union(spark.createDataFrame([(-1, None, True, 40)], df.sparkSession.createDataFrame([], "call_id long, host_chr string, host_rev boolean, host_pos long").schema))
    near = calls.nearest_mates(df, CFG)
    assert "unboundedfollowing" not in near._jdf.queryExecution().toString().lower()
    got = {(r.rev, r.mate_id, r.dist): r.n for r in near.join(df, "call_id").groupBy(F.col("host_rev").alias("rev"), "mate_id", "dist").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 20_000 and {d for _, _, d in got} == {0}
    assert {m for rev, m, _ in got if rev} == {min(i for i in range(50) if i % 3 and i % 7 == k) for k in range(7)}


def _edges_of(spark, spans):
    return spark.createDataFrame([("h", "+", a, b, "v", "-", c, d) for a, b, c, d in spans], "h_chr string, h_strand string, h_left long, h_right long, v_chr string, v_strand string, v_left long, v_right long")


def _holds(x, y):
    return x[0] <= y[0] and y[1] <= x[1] and x[2] <= y[2] and y[3] <= x[3]


@pytest.mark.parametrize("dense,slice_rows", [(64, 200_000), (0, 40), (0, 1000), (1000, 1)])
def test_containers_against_all_pairs(spark, dense, slice_rows):
    rng = random.Random(7)
    near = {(a, a + rng.randint(0, 200), c, c + rng.randint(0, 200)) for a, c in ((rng.randint(0, 300), rng.randint(0, 300)) for _ in range(120))}
    wide = {(a, a + rng.choice([0, 900, 1024, 5000, 70_000]), c, c + rng.choice([0, 3, 1023, 4096, 9000])) for a, c in ((rng.randint(-20, 9000), rng.randint(0, 3000)) for _ in range(60))}
    spans = near | wide
    got = {((r.h_left, r.h_right, r.v_left, r.v_right), (r.to_h_left, r.to_h_right, r.to_v_left, r.to_v_right)) for r in edges.containers(_edges_of(spark, spans), dense, slice_rows).collect()}
    top = [x for x in spans if not any(_holds(y, x) and y != x for y in spans)]
    assert got == {(x, min(y for y in top if _holds(y, x))) for x in spans}


def test_containers_of_repeated_null_and_no_edges(spark):
    df = _edges_of(spark, [(0, 9, 0, 9), (0, 9, 0, 9), (2, 3, 4, 4), (None, 3, 4, 4)])
    other = df.withColumn("h_strand", F.lit("-")).where("h_left = 2")
    got = sorted((r.h_strand, r.h_left, r.to_h_left) for r in edges.containers(df.unionByName(other)).collect())
    assert got == [("+", 0, 0), ("+", 2, 0), ("-", 2, 2)]
    assert edges.containers(df.limit(0)).count() == 0


def test_first_containers_on_dense_spans():
    rng = np.random.default_rng(3)
    for t in range(60):
        outer, inner = (np.unique(np.stack([a := rng.integers(0, 25, n), a + rng.integers(0, 20, n), c := rng.integers(0, 25, n), c + rng.integers(0, 20, n)], 1), axis=0) for n in rng.integers(1, 90, 2))
        inner = outer if t % 2 else inner
        for proper in (False, True):
            found = {int(k): tuple(x) for k, x in zip(*containment.first_containers(inner, outer, proper), strict=True)}
            for k, x in enumerate(inner):
                want = [tuple(y) for y in outer if _holds(y, x) and not (proper and tuple(x) == tuple(y))]
                assert (k in found) == bool(want)
                assert not want or (found[k] in want if proper else found[k] == min(want))


@pytest.mark.parametrize("name", ["alt_candidates", "coverage_windows"])
def test_rows_are_not_dealt_by_contig_to_meet_a_short_list(spark, name):
    """The contigs' list is shipped; nothing is hashed by contig alone, which would put a contig into one task."""
    from junctura.plans.queries import QUERIES

    import junctura.plans.records  # noqa: F401

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(chr#\d+L?, \d+\)", plan)


def test_mate_fields_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Two rows of a segment that differ in their flags alone."""
    from junctura.plans.records import mate_fields

    base = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(1).drop("l_orderkey", "l_suppkey", "l_linenumber", "l_linestatus")
    rows = spark.createDataFrame([(1, 27, 2), (1, 23, 2), (1, 11, 4), (1, 11, 1), (1, 0, 3)], "l_orderkey long, l_suppkey long, l_linenumber int")
    rows = rows.union(spark.createDataFrame([(1, s, n) for s, n in ((22, 2), (2, 2))], rows.schema)).crossJoin(base).withColumn("l_linestatus", F.lit("X"))
    seen = set()
    for k, order in enumerate((F.col("l_suppkey").asc(), F.col("l_suppkey").desc())):
        rows.coalesce(1).sortWithinPartitions(order).write.parquet(str(tmp_path / f"{k}" / "lineitem.parquet"))
        seen.add(tuple(sorted(map(tuple, mate_fields(spark, str(tmp_path / f"{k}")).collect()))))
    assert len(seen) == 1
    assert {row[1]: row[2] & 4 for row in next(iter(seen))}[1] == 0  # of equal rows the smaller flag, which is mapped


def test_mates_and_extraction(spark):
    rows = [("a", 1, 65 + 256, "h", 10, True, "5M", "v", 7, 99), ("a", 2, 129 + 32, "v", 7, False, "6M", "h", 10, -99), ("b", 1, 65, "h", 1, False, "5M", None, None, 0)]
    df = spark.createDataFrame(rows, "read_id string, seg int, flag int, chr string, pos long, rev boolean, cigar string, mate_chr string, mate_pos long, tlen long")
    got = {(r.read_id, r.seg): (r.flag, r.mate_chr, r.mate_pos, r.tlen, r.mate_cigar) for r in records.with_mate_fields(df).collect()}
    assert got == {("a", 1): (65, "v", 7, 99, "6M"), ("a", 2): (129 + 32, "h", 10, -99, "5M")}
    assert records.with_mate_fields(df.limit(0)).count() == 0
    reads = spark.createDataFrame([("c", 5, 0), ("c", 5, 4), ("c", 6, 3), ("c", 40, 9), ("d", 6, 9)], "chr string, start long, tlen long")
    assert {(r.chr, r.start, r.end, r.n) for r in records.sampling_regions(reads, least=1).collect()} == {("c", 5, 9, 2), ("c", 40, 49, 1), ("d", 6, 15, 1)}
    contigs = spark.createDataFrame([("x", 3), ("y", 0), ("z", 5)], "chr string, len long")
    places = records.random_positions(contigs, 500, seed=1).collect()
    assert len(places) == 500 and {(r.chr, r.pos) for r in places} == {("x", k) for k in range(3)} | {("z", k) for k in range(5)}
    assert records.random_positions(contigs.limit(0), 5, seed=1).count() == 0


def test_entries_lie_where_the_contig_has_them(spark):
    """Reads from both strands, aligned to regions of both strands, come back to where they were taken from."""
    rng = random.Random(8)
    contigs = {"h": "".join(rng.choices("ACGT", k=400)), "v": "".join(rng.choices("ACGT", k=300))}

    def rc(s):
        return s[::-1].translate(str.maketrans("ACGT", "TGCA"))

    regions, members, segments, truth = [], [], [], {}
    for i in range(12):
        for side, chrom in (("h", "h"), ("v", "v")):
            left = rng.randint(0, 100)
            strand = rng.choice("+-")
            window = contigs[chrom][left : left + 150]
            regions.append((f"{side}{i}", chrom == "v", rc(window) if strand == "-" else window, chrom, strand, left))
            at, turned = left + rng.randint(0, 100), rng.random() < 0.5
            piece = contigs[chrom][at : at + 45]
            segments.append((i, chrom == "v", rc(piece) if turned else piece))
            members.append((f"{side}{i}", i))
            truth[i, chrom == "v"] = (chrom, at, turned, piece)
    r = spark.createDataFrame(regions, "region_id string, is_virus boolean, seq string, chr string, strand string, left long")
    s = spark.createDataFrame(segments, "frag_id long, is_virus boolean, seq string")
    found = align.align_segments(spark.createDataFrame(members, "region_id string, frag_id long"), r, s)
    pairs = align.on_both_sides(spark.createDataFrame([(f"h{i}", f"v{i}", i) for i in range(12)], "h_region string, v_region string, frag_id long"), found, ["ref_begin", "ref_end", "cigar", "q_strand"])
    for side, virus in (("h", False), ("v", True)):
        facts = r.where(F.col("is_virus") == virus).select(F.col("region_id").alias(f"{side}_region"), F.col("chr").alias(f"{side}_chr"), F.col("strand").alias(f"{side}_strand"), F.col("left").alias(f"{side}_left"), F.length("seq").alias(f"{side}_len"))
        own = s.where(F.col("is_virus") == virus).select("frag_id", F.col("seq").alias(f"{side}_seq"))
        pairs = pairs.join(facts, f"{side}_region").join(own, "frag_id").withColumnsRenamed({f"{side}_ref_begin": f"{side}_begin", f"{side}_ref_end": f"{side}_end"})
    got = {(e.frag_id, e.is_virus): e for e in records.alignment_entries(pairs).collect()}
    assert len(got) == 24
    for key, (chrom, at, turned, piece) in truth.items():
        e = got[key]
        assert (e.chr, e.pos, e.seq, e.cigar) == (chrom, at, piece, "45=")
        other = truth[key[0], not key[1]]
        assert e.flag == 1 + (128 if key[1] else 64) + 16 * turned + 32 * other[2] and (e.mate_chr, e.mate_pos) == other[:2]


def test_region_sequences_over_chunks(spark):
    rng = random.Random(9)
    contigs = [(f"c{k}", "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 9, 10, 11, 57])))) for k in range(12)]
    c = spark.createDataFrame(contigs, "chr string, seq string")
    rows = [(name, max(0, a), b, rng.choice("+-")) for name, s in contigs for a, b in [(0, len(s)), (3, 25), (9, 10), (10, 30), (50, 99)]]
    w = spark.createDataFrame(rows, "chr string, start long, end long, strand string")
    got = {(r.chr, r.start, r.end, r.strand): r.seq for r in windows.region_sequences(w, windows.contig_chunks(c, 10), 10).collect()}
    seqs = dict(contigs)
    for name, a, b, strand in rows:
        s = seqs[name][a:b]
        assert got[name, a, b, strand] == (s[::-1].translate(str.maketrans("ACGT", "TGCA")) if strand == "-" else s)


def test_dust_searches_only_where_something_may_be_masked(monkeypatch):
    """What is scored in full is little beside the sequences, and what comes out is what a search of everything finds."""
    rng = random.Random(6)
    plain = ["".join(rng.choices("ACGT", k=500)) for _ in range(40)]
    seqs = [p[:250] + "AC" * (k % 20) + p[250:] for k, p in enumerate(plain)] + ["", "A", "AAAA" * 9, "Aü" * 20]
    searched, masked = [], dust._masked
    ends = np.cumsum([len(s) + 3 for s in seqs]) - 3
    letters = np.array([ord(c) for c in "\0\0\0".join(seqs)])
    a, b = masked(letters, ends - [len(s) for s in seqs], ends, 64, 2.0)
    of = np.searchsorted(ends, a, side="right")
    want = [[(int(x - ends[k]) + len(s), int(y - ends[k]) + len(s)) for x, y in zip(a[of == k], b[of == k], strict=True)] for k, s in enumerate(seqs)]
    monkeypatch.setattr(dust, "_masked", lambda cut, *rest: searched.append(len(cut)) or masked(cut, *rest))
    assert dust.dust_spans_of(seqs) == want and sum(map(len, want)) > 10
    assert sum(searched) < len(letters) / 3


def test_bases_of_lines_are_made_once(spark, tmp_path):
    texts = [(1, "Ab z\n\n-- 12\nK İ\né\nACGT"), (2, None), (3, ""), (4, "\n\n q")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = V.dna_lines(spark, str(tmp_path))
    every = V.table(spark, str(tmp_path), "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).select("doc_id", "line", V.dna(F.col("t")).alias("s"))
    assert sorted(map(tuple, lines.collect())) == sorted(tuple(r) for r in every.collect() if r.s) and lines.count() == 4
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
