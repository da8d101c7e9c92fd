"""Operators against plain Python on small random inputs."""

import bisect
import itertools
import random

import pytest
from pyspark.sql import functions as F

from junctura.config import JunctionConfig
from junctura.operators import align, calls, candidates, clean, cluster, dust, edgeproc, edges, ranges, screen

CFG = JunctionConfig()


def test_range_join(spark):
    rng = random.Random(1)
    a = [(rng.choice("xy"), rng.randint(-50, 300), i) for i in range(120)]
    b = [(rng.choice("xy"), rng.randint(-50, 300), i) for i in range(120)]
    got = ranges.range_join(spark.createDataFrame(a, "k string, p int, i int"), spark.createDataFrame(b, "k string, q int, j int"), ["k"], "p", "q", 17).collect()
    want = {(x[2], y[2]) for x in a for y in b if x[0] == y[0] and abs(x[1] - y[1]) <= 17}
    assert len(got) == len(want) and {(r.i, r.j) for r in got} == want


def test_overlaps_and_exclusion(spark):
    rng = random.Random(2)
    spans = [(rng.choice("xy"), s := rng.randint(0, 400), s + rng.randint(0, 90), i) for i in range(80)]
    holes = [(rng.choice("xy"), s := rng.randint(0, 400), s + rng.randint(0, 20)) for _ in range(40)]
    left = spark.createDataFrame(spans, "chr string, start int, end int, i int")
    right = spark.createDataFrame(holes, "chr string, ex_start int, ex_end int")
    got = ranges.overlap_join(left, right, ["chr"], ("start", "end"), ("ex_start", "ex_end"), 32).collect()
    want = sorted((a[3], *b[1:]) for a in spans for b in holes if a[0] == b[0] and a[1] < b[2] and b[1] < a[2] and a[1] < a[2] and b[1] < b[2])
    assert sorted((r.i, r.ex_start, r.ex_end) for r in got) == want
    cut = ranges.exclude(left, right, trim=True).collect()
    bases = {(r.i, p) for r in cut for p in range(r.start, r.end)}
    assert bases == {(a[3], p) for a in spans for p in range(a[1], a[2]) if not any(h[0] == a[0] and h[1] <= p < h[2] for h in holes)}
    kept = {r.i for r in ranges.exclude(left, right).collect()}
    assert kept == {a[3] for a in spans} - {w[0] for w in want}


def test_coverage(spark):
    windows = spark.createDataFrame([(1, "a", 0, 100), (2, "a", 200, 300), (3, "b", 0, 10)], "id int, chr string, w_start int, w_end int")
    spans = spark.createDataFrame([("a", 10, 30), ("a", 20, 40), ("a", 90, 210)], "chr string, s int, e int")
    got = {r.id: (r.covered, r.share) for r in ranges.covered_share(windows, spans).collect()}
    assert got == {1: (40, 0.4), 2: (10, 0.1), 3: (0, 0.0)}


def test_seed_screen_tolerates_one_block(spark):
    rng = random.Random(5)
    ref = "".join(rng.choices("ACGT", k=60))
    one = ref[10:13] + "".join("A" if c != "A" else "C" for c in ref[13:16]) + ref[16:32]
    two = "".join(("A" if c != "A" else "C") if i in (3, 12) else c for i, c in enumerate(ref[10:29]))
    reads = [("hit", 1, one), ("hit", 2, "T" * 30), ("miss", 1, two), ("miss", 2, "G" * 30), ("short", 1, "ACG"), ("short", 2, "")]
    refs = spark.createDataFrame([(ref,)], "seq string")
    df = spark.createDataFrame(reads, "read_id string, seg int, seq string")
    assert {r.read_id for r in screen.screen_reads(df, refs, CFG).collect()} == {"hit"}
    assert screen.screen_reads(df.limit(0), refs, CFG).count() == 0


def test_template_switch(spark):
    alt = "array<struct<chr:string,rev:boolean,pos:int,cigar:string,nm:int,is_virus:boolean>>"
    rows = [
        ("drop1", "20S80M", False, False, [("h", False, 1, "80M20S", 0, False)]), ("keep1", "20S80M", False, False, [("v", False, 1, "80M20S", 0, True)]),
        ("drop2", "20S80M", False, False, [("h", True, 1, "20S80M", 0, False)]), ("keep2", "100M", False, False, [("h", True, 1, "20S80M", 0, False)]),
        ("drop3", "20S60M20S", False, False, []), ("keep3", "20S80M", False, False, None),
    ]
    df = spark.createDataFrame(rows, f"read_id string, cigar string, rev boolean, is_virus boolean, alts {alt}")
    assert sorted(r.read_id for r in clean.without_template_switches(df).collect()) == ["keep1", "keep2", "keep3"]


def test_fixpoint_rounds(spark):
    rng = random.Random(8)
    members = {(rng.choice("ABCDEFGH"), rng.randint(0, 25)) for _ in range(70)}
    rows = [(r, r in "ABCD", f, False) for r, f in members]
    got = {(r.region, r.frag_id) for r in cluster.filter_fixpoint(spark.createDataFrame(rows, "region string, is_virus boolean, frag_id int, is_split boolean"), ["region"], 7).collect()}
    now = set(members)
    while True:
        strong = {r for r in {m[0] for m in now} if sum(m[0] == r for m in now) >= 7}
        kept = {m for m in now if m[0] in strong}
        if kept == now:
            break
        both = {f for f in {m[1] for m in kept} if {m[0] in "ABCD" for m in kept if m[1] == f} == {True, False}}
        now = {m for m in kept if m[1] in both}
        if now == kept:
            break
    assert got == now


def test_fixpoint_does_not_end_early(spark):
    # Region k has fragments k and k + 1, the last one k alone; each round the last region falls and takes that with it.
    rows = [(k, k % 2 == 0, f, False) for k in range(8) for f in (k, k + 1) if f < 8]
    df = spark.createDataFrame(rows, "region int, is_virus boolean, frag_id int, is_split boolean")
    assert cluster.filter_fixpoint(df, ["region"], 2).count() == 0
    with pytest.raises(RuntimeError):
        cluster.filter_fixpoint(df, ["region"], 2, max_rounds=2)


def gotoh(q, r, cfg):
    """Textbook local score, without a deletion straight after an insertion."""
    low = -(10**9)
    best = 0
    h = [[0] * (len(r) + 1) for _ in range(len(q) + 1)]
    ins = [[low] * (len(r) + 1) for _ in range(len(q) + 1)]
    for i in range(1, len(q) + 1):
        dele = low
        m_before = 0
        for j in range(1, len(r) + 1):
            m = h[i - 1][j - 1] + (cfg.match if q[i - 1] == r[j - 1] and q[i - 1] in "ACGT" else -cfg.mismatch)
            ins[i][j] = max(h[i - 1][j] - cfg.gap_open, ins[i - 1][j] - cfg.gap_extend)
            dele = max(max(m_before, 0) - cfg.gap_open, dele - cfg.gap_extend)
            h[i][j] = max(0, m, ins[i][j], dele)
            m_before = m
            best = max(best, h[i][j])
    return best


def test_alignment_scores_and_paths():
    rng = random.Random(6)
    cfg = JunctionConfig(mismatch=2, gap_open=3)
    for _ in range(150):
        r = "".join(rng.choices("ACGTN", weights=[5, 5, 5, 5, 1], k=rng.randint(1, 60)))
        q = list(r[rng.randint(0, len(r) // 2) :])
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(q))
            q[at : at + rng.randint(0, 2)] = rng.choices("ACGT", k=rng.randint(0, 2))
        q = "".join(q)
        want = gotoh(q, r, cfg) if q else 0
        got = align.align(q, r, cfg)
        assert (got[0] if got else 0) == want
        if got:
            score, rb, re_, qb, qe, cigar = got
            import re

            ops = [(int(n), op) for n, op in re.findall(r"(\d+)([SXID=])", cigar)]
            assert sum(n for n, op in ops if op in "=XIS") == len(q)
            assert sum(n for n, op in ops if op in "=XD") == re_ - rb + 1
            total = sum(n * cfg.match if op == "=" else -n * cfg.mismatch if op == "X" else -cfg.gap_open - (n - 1) * cfg.gap_extend if op in "ID" else 0 for n, op in ops)
            assert total >= score and qb == (ops[0][0] if ops[0][1] == "S" else 0)


def test_both_strands(spark):
    df = spark.createDataFrame([("ACGTTGCAGG", "TTACGTTGCAGGTT"), ("CCTGCAACGT", "TTACGTTGCAGGTT"), (None, "AC"), ("", "AC")], "q string, r string")
    got = [(r.score, r.ref_begin, r.q_strand) for r in align.align_both_strands(df, "q", "r").collect()]
    assert got == [(10, 2, "+"), (10, 2, "-"), (None, None, "-"), (None, None, "-")]


def test_duplicates_one_by_one(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.randint(0, 12), rng.randint(0, 12)) for i in range(150)]
    got = {(r.e, r.frag_id) for r in edgeproc.remove_duplicates(spark.createDataFrame(rows, "e string, frag_id int, h_distal int, v_distal int"), ["e"]).collect()}
    want, seen = set(), set()
    for e, i, h, v in sorted(rows, key=lambda r: r[1]):
        if (e, "h", h) not in seen and (e, "v", v) not in seen:
            seen |= {(e, "h", h), (e, "v", v)}
            want.add((e, i))
    assert got == want


def plain_pack(rows, need):
    left, taken = {}, {}
    for e, f, s in rows:
        left.setdefault(e, {})[f] = s
    while left:
        e = min(left, key=lambda x: (-sum(left[x].values()), x))
        reads = left.pop(e)
        if len(reads) >= need:
            taken[e] = set(reads)
            for other in left.values():
                for f in reads:
                    other.pop(f, None)
        left = {k: v for k, v in left.items() if v}
    return taken


@pytest.mark.parametrize("bound", [10**6, 20])
def test_packing(spark, monkeypatch, bound):
    monkeypatch.setattr(edgeproc, "PACK_ROWS", bound)
    rng = random.Random(bound)
    rows = sorted({(rng.randint(0, 11), rng.randint(0, 60)) for _ in range(110)})
    rows = [(e, f, rng.randint(1, 9)) for e, f in rows]
    got: dict = {}
    for r in edgeproc.pack_edges(spark.createDataFrame(rows, "e int, frag_id int, score int"), ["e"]).collect():
        got.setdefault(r.e, set()).add(r.frag_id)
    assert got == plain_pack(rows, CFG.edge_reads)


def test_packing_is_the_same_in_tasks_and_rounds(spark, monkeypatch):
    """Any number of fragments of one split read is one unit, whichever way edges are packed."""
    rng = random.Random(8)
    fields = "e int, frag_id int, score int, read_id int, is_split boolean"
    for size in (2, 3, 5):
        read = {f: (f // size, True) if f < 40 else (f, False) for f in range(70)}
        rows = [(e, f, rng.randint(1, 9), *read[f]) for e, f in sorted({(rng.randint(0, 14), rng.randint(0, 69)) for _ in range(150)})]
        df = spark.createDataFrame(rows, fields)
        found = []
        for bound in (10**6, 0):
            monkeypatch.setattr(edgeproc, "PACK_ROWS", bound)
            found.append({tuple(r) for r in edgeproc.pack_edges(df, ["e"]).collect()})
        assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("bound", [10**6, 10])
def test_packing_of_split_mates(spark, monkeypatch, bound):
    monkeypatch.setattr(edgeproc, "PACK_ROWS", bound)
    fields = "e int, frag_id int, score int, read_id int, is_split boolean"
    # Edge 1: three reads and split support; 2: 31 is the mate of 30 and leaves; 3: mates count half each, too few.
    rows = [(1, f, 9, f, False) for f in (10, 11)] + [(1, 30, 9, 7, True)]
    rows += [(2, 31, 5, 7, True)] + [(2, f, 4, f, False) for f in (20, 21, 22)]
    rows += [(3, 40, 2, 8, True), (3, 41, 2, 8, True), (3, 42, 2, 42, False), (3, 22, 1, 22, False)]
    rows += [(4, 50, 2, 9, True), (4, 51, 2, 9, True), (4, 52, 2, 52, False), (4, 42, 1, 42, False)]
    found: dict = {}
    for r in edgeproc.pack_edges(spark.createDataFrame(rows, fields), ["e"]).collect():
        found.setdefault(r.e, set()).add(r.frag_id)
    assert found == {1: {10, 11, 30}, 3: {40, 41, 42, 22}}
    rng = random.Random(4)
    read = {f: (f // 2, True) if f < 30 else (f, False) for f in range(60)}
    rows = sorted({(rng.randint(0, 11), rng.randint(0, 59)) for _ in range(110)})
    rows = [(e, f, rng.randint(1, 9), *read[f]) for e, f in rows]
    left, want = {}, {}
    for e, f, s, *_ in rows:
        left.setdefault(e, {})[f] = s
    while left:
        e = min(left, key=lambda x: (-sum(left[x].values()), x))
        gone = left.pop(e)
        if len({read[f] for f in gone}) + any(read[f][1] for f in gone) >= CFG.edge_reads:
            want[e] = set(gone)
            used = {read[f] for f in gone}
            left = {k: {f: s for f, s in v.items() if read[f] not in used} for k, v in left.items()}
        left = {k: v for k, v in left.items() if v}
    found = {}
    for r in edgeproc.pack_edges(spark.createDataFrame(rows, fields), ["e"]).collect():
        found.setdefault(r.e, set()).add(r.frag_id)
    assert found == want


def test_split_of_all_edges(spark):
    rng = random.Random(11)
    rows, want = [], set()
    for e in range(6):
        alleles = ["".join(rng.choices("ACGT", k=30)) for _ in range(1 + e % 3)]
        reads = [(f, "".join(c if rng.random() > 0.03 else rng.choice("ACGTN") for c in alleles[rng.randrange(len(alleles))][: rng.randint(24, 30)])) for f in range(18)]
        read = {f: (f // 2, True) if f < 6 else (f, False) for f, _ in reads}
        rows += [(e, f, s, *read[f]) for f, s in reads]
        mates = {f: f ^ 1 for f in range(6)}
        parts = edgeproc.split_edge([f for f, _ in reads], [s for _, s in reads], mates, set(range(6)), CFG)
        want |= {(e, k > 0, frozenset(p)) for k, p in enumerate(parts) if p}
    df = spark.createDataFrame(rows, "e int, frag_id int, seq string, read_id int, is_split boolean")
    found: dict = {}
    for r in edgeproc.split_edges(df, ["e"]).collect():
        found.setdefault((r.e, r.part), set()).add(r.frag_id)
    assert {(e, k > 0, frozenset(p)) for (e, k), p in found.items()} == want and any(k for _, k in found)


def test_consensus_and_split(spark):
    rows = [(1, k, s) for k, s in enumerate(["ACGT", "ACGA", "ANGTT", "TCNT"])]
    df = spark.createDataFrame(rows, "g int, k int, seq string")
    agreed = edgeproc.consensus(df, ["g"], "k")
    assert agreed.first()["consensus"] == "ACGTT"
    diffs = {r.k: r.diffs for r in edgeproc.difference_counts(df, agreed, ["g"], "k").collect()}
    assert diffs == {0: 0, 1: 1, 2: 0, 3: 1}
    a, b = "ACGTACGTACGTACGTACGT", "ACGTACGTACTTACGAACGT"
    parts = edgeproc.split_edge(list(range(11)), [a] * 6 + [b] * 5, {}, set(), CFG)
    assert parts == [set(range(6)), set(range(6, 11))]


@pytest.mark.parametrize("stretch", [5, 1024])
def test_consensus_in_stretches_and_batches(spark, monkeypatch, stretch):
    """Groups that go over many batches, against counting by the letter; letters are not rows."""
    monkeypatch.setattr(edgeproc, "STRETCH", stretch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = random.Random(8)
    rows = [(g, f"x{g % 2}" if g else None, k, "".join(rng.choices("ACGTNé", k=rng.randint(0, 12)))) for g in range(9) for k in range(rng.choice([1, 3, 40]))]
    df = spark.createDataFrame(rows, "g int, h string, k int, seq string").repartition(3)
    agreed = edgeproc.consensus(df, ["g", "h"], "k")
    got = {(r.g, r.h): r.consensus for r in agreed.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want: dict = {}
    for g, h in {r[:2] for r in rows}:
        mine = [(k, s) for a, b, k, s in rows if (a, b) == (g, h)]
        text = ""
        for at in range(max(len(s) for _, s in mine)):
            seen = [(k, s[at]) for k, s in mine if len(s) > at]
            rank = {c: (c != "N", sum(x == c for _, x in seen), -max(k for k, x in seen if x == c)) for _, c in seen}
            text += max(rank, key=rank.get)
        if text:
            want[g, h] = text
    assert got == want
    assert "posexplode" not in agreed._jdf.queryExecution().toString().lower()


def test_effective_and_unique_reads(spark):
    rows = [("e", 1, 1, 1), ("e", 1, 2, 2), ("e", 2, None, 3), ("f", 2, None, 3)]
    df = spark.createDataFrame(rows, "edge string, read_id int, seg int, frag_id int")
    assert {r.edge: r.effective for r in edges.effective_reads(df, ["edge"]).collect()} == {"e": 3.0, "f": 1.0}
    assert {r.edge: (r.n_reads, r.n_unique) for r in edges.unique_reads(df, ["edge"]).collect()} == {"e": (3, 2), "f": (1, 0)}


def test_acceptance(spark):
    fields = "call_id int, host_pbs double, good_pairs int, split_reads int, host_cov double, virus_cov double, host_len int, virus_len int, host_masked int, virus_masked int"
    rows = [(1, 0.9, 3, 0, 0.1, 0.1, 99, 99, 0, 0), (2, 0.9, 3, 1, 0.1, 0.1, 99, 99, 0, 0), (3, 0.1, 3, 0, 0.5, 0.5, 99, 99, 0, 0), (4, 0.9, 9, 9, 0.9, 0.9, 99, 99, 80, 0), (5, 0.9, 9, 9, 0.1, 0.1, 74, 99, 0, 0)]
    got = {r.call_id: r.accepted for r in calls.accept_calls(spark.createDataFrame(rows, fields), CFG).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: False}


def test_pairing_and_duplicate_calls(spark):
    rows = [(1, "h", True, 100, True), (2, "h", False, 90, True), (3, "h", False, 95, True), (4, "h", True, 2000, True), (5, "h", False, 1990, False)]
    df = spark.createDataFrame(rows, "call_id int, host_chr string, host_rev boolean, host_pos int, accepted boolean")
    assert {r.call_id: r.paired_with for r in calls.pair_calls(df, CFG).collect()} == {1: 3, 3: 1, 4: 5, 5: 4}
    s = "".join(random.Random(1).choices("ACGT", k=60))
    rc = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    more = [(1, False, s, s), (2, True, rc[:50], rc[5:]), (3, False, "ACGT" * 15, s), (4, False, "", s)]
    dup = spark.createDataFrame([(i, "h", "v", rev, rev, h, v) for i, rev, h, v in more], "call_id int, host_chr string, virus_chr string, host_rev boolean, virus_rev boolean, host_seq string, virus_seq string")
    assert [r.call_id for r in calls.duplicate_calls(dup, CFG).collect()] == [2]


@pytest.mark.parametrize("bound", [10**6, 40, 0])
def test_pairing_in_rounds_and_tasks(spark, monkeypatch, bound):
    monkeypatch.setattr(calls, "PAIR_ROWS", bound)
    rng = random.Random(9)
    ids = rng.sample(range(1000), 90)
    rows = [(i, rng.choice(["h0", "h1"]), rng.random() < 0.5, rng.randint(0, 6000), rng.random() < 0.5) for i in ids]
    df = spark.createDataFrame(rows, "call_id long, host_chr string, host_rev boolean, host_pos long, accepted boolean")
    by_turn = sorted(rows)
    partner: dict = {}
    for both in (True, False):
        for i, c, rev, pos, ok in by_turn:
            options = []
            for j, c2, rev2, pos2, ok2 in rows:
                dist = (pos - pos2) if rev else (pos2 - pos)
                if c == c2 and rev != rev2 and -50 <= dist <= 1000 and ok and ok2 == both and j not in partner:
                    options.append((abs(dist), j))
            if options and i not in partner:
                partner[i], partner[min(options)[1]] = min(options)[1], i
    got = [(r.call_id, r.paired_with) for r in calls.pair_calls(df, CFG).collect()]
    assert sorted(got) == sorted(partner.items()) and len(got) > 20
    assert calls.pair_calls(df.limit(0), CFG).count() == 0


@pytest.mark.parametrize("steps", [2, 4])
def test_pairing_of_dense_calls_needs_few_rounds(spark, monkeypatch, steps):
    """Every call has hundreds of partners, over many blocks; the rounds do not grow with that."""
    monkeypatch.setattr(calls, "PAIR_ROWS", 300)
    monkeypatch.setattr(calls, "PAIR_STEPS", steps)
    rng = random.Random(4)
    rows = [(i, "h0", rng.random() < 0.4, rng.randint(0, 60_000), rng.random() < 0.4) for i in rng.sample(range(10**6), 20_000)]
    df = spark.createDataFrame(rows, "call_id long, host_chr string, host_rev boolean, host_pos long, accepted boolean")
    made = []
    monkeypatch.setattr(calls, "materialize", lambda d, name, f=calls.materialize: made.append(name) or f(d, name))
    got = {(r.call_id, r.paired_with) for r in calls.pair_calls(df, CFG).collect()}
    partner: dict = {}
    for both in (True, False):
        places = {side: sorted((p, i) for i, _, rev, p, ok in rows if rev == side and (both is ok or not both) and i not in partner) for side in (True, False)}
        accepted = {r[0]: r[4] for r in rows}
        for i, _, rev, pos, ok in sorted(rows):
            if not ok or i in partner:
                continue
            low, high = (pos - 1000, pos + 50) if rev else (pos - 50, pos + 1000)
            there = places[not rev]
            options = [(abs(p - pos), j) for p, j in there[bisect.bisect_left(there, (low, -1)) : bisect.bisect_left(there, (high + 1, -1))] if j not in partner and accepted[j] == both]
            if options:
                partner[i], partner[min(options)[1]] = min(options)[1], i
    assert got == set(partner.items()) and len(got) > 9_000
    assert made.count("pairs") <= 8


def test_dust():
    rng = random.Random(0)
    plain = "".join(rng.choices("ACGT", k=80))
    assert dust.dust_spans(plain) == []
    spans = dust.dust_spans(plain + "A" * 40 + plain)
    assert len(spans) == 1 and spans[0][0] <= 80 and spans[0][1] >= 120 and spans[0][1] - spans[0][0] < 60
    assert dust.dust_spans("") == []


def test_split_candidates(spark):
    anchors = spark.createDataFrame([("r", 1, "L", False, "h0", 100, 150)], "read_id string, seg int, side string, anchor_is_virus boolean, chr string, pos int, end int")
    clips = spark.createDataFrame([("r", 1, "L", "v0", 7, 37, True)], "read_id string, seg int, side string, c_chr string, c_pos int, c_end int, c_rev boolean")
    got = {(r.chr, r.pos, r.strand) for r in candidates.split_candidates(anchors, clips).collect()}
    assert got == {("h0", 100, "-"), ("v0", 37, "+")}


def test_subsumption(spark):
    e = lambda hl, hr, vl, vr, f: ("h", "+", hl, hr, "v", "-", vl, vr, f)
    rows = [e(10, 50, 5, 20, 1), e(10, 40, 5, 20, 1), e(10, 40, 5, 20, 2), e(45, 80, 5, 20, 3), e(200, 210, 1, 2, 4)]
    df = spark.createDataFrame(rows, "h_chr string, h_strand string, h_left int, h_right int, v_chr string, v_strand string, v_left int, v_right int, frag_id int")
    got = sorted((r.h_left, r.h_right, r.frag_id) for r in edges.subsume(df).collect())
    assert got == [(10, 50, 1), (10, 50, 2), (45, 80, 3), (200, 210, 4)]


def _letters_with(rng, k, changes):
    s = list("".join(rng.choices("ACGT", k=k)))
    return "".join(s), "".join(rng.choice("ACGT") if rng.random() < changes else c for c in s)


@pytest.mark.parametrize("block", [256, 3])
def test_duplicate_calls_as_all_pairs_have_them(spark, monkeypatch, block):
    monkeypatch.setattr(calls, "DUPLICATE_BLOCK", block)
    rng = random.Random(21)
    base = [rng.choice(_letters_with(rng, rng.randint(40, 70), 0.1)) for _ in range(5)]
    turned = str.maketrans("ACGT", "TGCA")

    def text(rev):
        s = rng.choice(base)
        s = "".join(rng.choice("ACGTN") if rng.random() < rng.choice([0, 0, 0.05, 0.15]) else c for c in s)[rng.randint(0, 9) : rng.randint(30, 70)]
        return s[::-1].translate(turned) if rev else s

    rows = [(i, rng.choice("hg"), "v", a := rng.random() < 0.3, b := rng.random() < 0.3, text(a) if rng.random() > 0.05 else "", text(b)) for i in rng.sample(range(1000), 45)]
    rows += [(2000 + i, *r[1:]) for i, r in enumerate(rows[::4])]

    def same(e, other, e_rev, other_rev):
        ref, query = (e, other) if len(e) >= len(other) else (other, e)
        a = align.align("".join(dict(zip("ACGT", "TGCA", strict=True)).get(c, "N") for c in query[::-1]) if e_rev != other_rev else query, ref, CFG)
        return a is not None and a[4] - a[3] >= CFG.duplicate_span * len(query)

    want = {x[0] for e in rows for x in rows if e[0] < x[0] and e[1] == x[1] and all((e[5], e[6], x[5], x[6])) and same(e[5], x[5], e[3], x[3]) and same(e[6], x[6], e[4], x[4])}
    df = spark.createDataFrame(rows, "call_id long, host_chr string, virus_chr string, host_rev boolean, virus_rev boolean, host_seq string, virus_seq string")
    assert {r.call_id for r in calls.duplicate_calls(df, CFG).collect()} == want and len(want) > 11


def test_spans_query_traces_nothing(monkeypatch):
    def unwanted(*_):
        raise AssertionError

    monkeypatch.setattr(align, "traces", unwanted)
    assert align.spans_query([("ACGTACGTAC", "TTACGTACGTACTT"), ("ACGTTTTTTT", "ACGTCCCC"), ("", "A"), ("NNNNNNNN", "NNNNNNNN")], 0.8, CFG).tolist() == [True, False, False, False]


@pytest.mark.parametrize("small", [10**6, 0])
def test_sharing_seeds_looks_seeds_up(spark, small):
    rng = random.Random(4)
    refs = [(i, "".join(rng.choices("ACGTñ𝔸", k=30))) for i in range(6)]
    reads = [(i, (s := rng.choice(refs)[1])[rng.randint(0, 12) :][: rng.choice([9, 10, 18])] + "".join(rng.choices("ACGT", k=rng.randint(0, 8)))) for i in range(40)] + [(90, ""), (91, None), (92, refs[0][1][:5]), (93, refs[0][1][5:15])]
    got = align.sharing_seeds(spark.createDataFrame(reads, "k int, seq string"), spark.createDataFrame(refs, "r int, seq string"), ["k"], "r", 10, small).collect()
    want = {(k, r) for k, s in reads for r, t in refs if any(s[i : i + 10] in t for i in range(len(s or "") - 9))}
    assert sorted(map(tuple, got)) == sorted(want)


def test_aligned_segments_reads_lines_once(spark, tmp_path, monkeypatch):
    from junctura.plans import queries

    rng = random.Random(6)
    items = ["".join(rng.choices("abghmnst", k=60)) for _ in range(4)]
    docs = [(k, "\n".join(["zz" + rng.choice(items)[5:55], "".join(rng.choices("agmt", k=30))])) for k in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    made, given = [], queries.V.dna_lines
    monkeypatch.setattr(queries.V, "dna_lines", lambda *a: made.append(a) or given(*a))
    got = queries.aligned_segments(spark, f"file://{tmp_path}").collect()
    assert {r.frag_id for r in got} == {f"{k}:0" for k in range(6)} and len(made) == 1


def _related(rng, n):
    """Pairs of a shorter and a longer text around a common core with changes, inserted and missing letters."""

    def around(core):
        more = ["".join(rng.choices("ACGT", k=rng.choice([0, 0, 8, 40]))) for _ in "ab"]
        at = rng.randint(0, len(core))
        cut = core[:at] + "".join(rng.choices("ACGT", k=rng.choice([0, 0, 3, 15]))) + core[at + rng.choice([0, 0, 4, 12]) :]
        rate = rng.choice([0, 0.03, 0.1, 0.2])
        return more[0] + "".join(rng.choice("ACGTN") if rng.random() < rate else c for c in cut) + more[1]

    cores = ["".join(rng.choices(rng.choice(["ACGT", "AC"]), k=rng.randint(10, 120))) for _ in range(n)]
    return [tuple(sorted((around(c), around(c)), key=len)) for c in cores]


@pytest.mark.parametrize("cfg", [CFG, JunctionConfig(mismatch=1, gap_open=2), JunctionConfig(match=2, gap_extend=2), JunctionConfig(match=30, mismatch=100, gap_open=150)])
def test_spans_query_by_both_ends_loses_no_pair(cfg):
    pairs = [p for p in _related(random.Random(8), 300) if p[0]]
    for share in (0.55, 0.8):
        got = align.spans_query(pairs, share, cfg).tolist()
        found = align.align_many(pairs, cfg)
        assert got == [a is not None and a[4] - a[3] >= share * len(q) for (q, _), a in zip(pairs, found, strict=True)] and 20 < sum(got) < 290


def test_spans_query_fills_no_pair_whose_ends_differ(monkeypatch):
    """Texts that share a passage, as an item's lines do; the rest of the shorter one isn't in the other."""
    rng = random.Random(9)
    passage = "".join(rng.choices("ACGT", k=60))
    texts = ["".join(rng.choices("ACGT", k=rng.randint(100, 150))) + passage + "".join(rng.choices("ACGT", k=rng.randint(100, 150))) for _ in range(25)]
    pairs = [tuple(sorted((a, b), key=len)) for a, b in itertools.combinations(texts, 2)]
    filled, ends = [], align.ends
    monkeypatch.setattr(align, "ends", lambda q, r, cfg: filled.append(len(q)) or ends(q, r, cfg))
    assert not align.spans_query(pairs, 0.8, CFG).any() and sum(filled) < len(pairs) // 20


def test_copies_are_compared_until_one_is_found(monkeypatch):
    """Near copies: one comparison each, not one a pair; calls of one kind from its second on."""
    import pyarrow as pa

    rng = random.Random(10)
    text = "".join(rng.choices("ACGT", k=200))
    copies = [text[:k] + rng.choice("ACGT") + text[k + rng.choice([0, 1]) :] for k in range(20, 180, 4)] + ["".join(rng.choices("ACGT", k=90))]
    made, given = [], calls.spans_query
    monkeypatch.setattr(calls, "spans_query", lambda pairs, *more: made.append(len(pairs)) or given(pairs, *more))
    rows = {"host_chr": "h", "virus_chr": "v", "low": 0, "high": 0, "block": 0, "host_rev": False, "virus_rev": False, "virus_seq": "ACGTACGTACGT"}
    kinds = pa.Table.from_pylist([rows | {"host_seq": s, "first": k, "last": 100 + k} for k, s in enumerate(copies)])
    got = {r["first"]: r["since"] for r in calls._earlier_duplicates(CFG)(kinds).to_pylist()}
    n = len(copies)
    assert all(got[k] < k for k in range(1, n - 1)) and got[0] == 0 and got[n - 1] == n - 1
    assert sum(made) < 8 * n < n * (n - 1) // 4
