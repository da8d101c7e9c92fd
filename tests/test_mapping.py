"""Reads placed by minimizers, chains and windows against alignment to everything."""

import random

import numpy as np
import pytest

from junctura.config import JunctionConfig
from junctura.operators import mapping
from junctura.operators.align import align, align_many, codes, fill
from junctura.operators.mapping import best_and_alternatives, chains, map_reads, minimizer_index, minimizers, write_index
from junctura.operators.windows import contig_chunks

CFG = JunctionConfig()
TURN = str.maketrans("ACGT", "TGCA")


def dna(rng, n):
    return "".join(rng.choices("ACGT", k=n))


def mutated(rng, s, rate):
    out = []
    for c in s:
        x = rng.random()
        out.append(rng.choice("ACGT") if x < rate else "" if x < 1.3 * rate else c + dna(rng, rng.randint(1, 3)) if x < 1.6 * rate else c)
    return "".join(out)


def test_minimizers_against_all_windows():
    rng = random.Random(1)
    for _ in range(60):
        s = "".join(rng.choices("ACGTN" if rng.random() < 0.3 else "ACG", k=rng.randint(0, 60)))
        k, w = rng.choice([(3, 4), (5, 1), (4, 7)])
        key, pos, rev = minimizers(codes(s), k, w)
        each = {}
        for p in range(len(s) - k + 1):
            got = minimizers(codes(s[p : p + k]), k, 1)
            each[p] = (got[0][0], got[2][0]) if len(got[0]) else None
        want, n = set(), len(s) - k + 1
        for p in range(max(0, n - min(w, n) + 1) if n > 0 else 0):
            there = [(each[x][0], x) for x in range(p, p + min(w, n)) if each[x]]
            want |= {x for h, x in there if h == min(there)[0]}
        assert pos.tolist() == sorted(want) and key.tolist() == [each[p][0] for p in pos] and rev.tolist() == [each[p][1] for p in pos]
    s = dna(rng, 400)
    other = minimizers(codes(s[::-1].translate(TURN)))
    assert sorted(zip(other[0].tolist(), (400 - mapping.K - other[1]).tolist(), (~other[2]).tolist())) == sorted(zip(*(x.tolist() for x in minimizers(codes(s)))))


def test_kernel_scores_against_the_whole_table():
    """Scores, ends and begins as a plain fill has them; operations add up to the score."""
    rng = random.Random(2)
    pairs = []
    for _ in range(300):
        r = "".join(rng.choices(rng.choice(["ACGT", "AC", "ACGTN"]), k=rng.randint(1, 80)))
        a = rng.randint(0, len(r) - 1)
        pairs.append((mutated(rng, r[a : a + rng.randint(1, 60)], rng.choice([0, 0.05, 0.2])) or "A", r))
    for (q, r), got in zip(pairs, align_many(pairs, CFG), strict=True):
        best = fill(codes(q), codes(r), CFG)[0]
        score = int(best.max())
        if score <= 0:
            assert got is None
            continue
        r_end = int(np.argmax(best.max(axis=0) == score))
        assert got[0] == score and got[2] == r_end - 1 and got[4] == int(np.argmax(best[:, r_end] == score)) - 1
        ops = mapping_ops(got[5])
        at, place, total = got[3], got[1], 0
        for n, op in ops:
            if op in "=X":
                assert all((q[at + x] == r[place + x] != "N") == (op == "=") for x in range(n))
                total += n * CFG.match if op == "=" else -n * CFG.mismatch
                at, place = at + n, place + n
            elif op in "ID":
                total -= CFG.gap_open + (n - 1) * CFG.gap_extend
                at, place = at + n * (op == "I"), place + n * (op == "D")
        assert (total, at, place) == (score, got[4] + 1, got[2] + 1)


def mapping_ops(cigar):
    import re

    return [(int(n), op) for n, op in re.findall(r"(\d+)([=XID])", cigar)]


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(7)
    repeat = dna(rng, 300)
    contigs = {"c1": dna(rng, 3000) + repeat + dna(rng, 1500), "c2": dna(rng, 900) + repeat + dna(rng, 700) + repeat[::-1].translate(TURN) + dna(rng, 300), "tiny": dna(rng, 10), "n": "N" * 200 + dna(rng, 100)}
    reads = []
    for k in range(150):
        chr_ = rng.choice(["c1", "c2"])
        at = rng.randint(0, len(contigs[chr_]) - 120)
        s = mutated(rng, contigs[chr_][at : at + 120], rng.choice([0, 0.01, 0.04]))
        reads.append((f"r{k}", s[::-1].translate(TURN) if rng.random() < 0.5 else s))
    reads += [("rep", repeat[50:170]), ("none", dna(rng, 120)), ("null", None), ("empty", ""), ("short", "ACGT"), ("lower", contigs["c1"][100:200].lower())]
    return contigs, reads


@pytest.mark.parametrize("width", [128, 1 << 16])
def test_recall_against_alignment_to_everything(spark, genome, width):
    contigs, reads = genome
    c = spark.createDataFrame(list(contigs.items()), "chr string, seq string")
    r = spark.createDataFrame([(*x, "x") for x in reads], "id string, seq string, chr string").drop("chr")
    got = {x["id"]: x for x in map_reads(r, c, ["id"], CFG, width=width).collect()}
    plain = {}
    for name, s in reads:
        if s:
            turned = [(chr_, rev, t) for chr_, t in contigs.items() for rev in (False, True)]
            found = align_many([(s.upper()[::-1].translate(TURN) if rev else s.upper(), t) for _, rev, t in turned], CFG)
            scores = [x[0] if x else 0 for x in found]
            if max(scores) >= CFG.min_score:
                plain[name] = max(scores)
    hit = sum(name in got and got[name]["score"] == best for name, best in plain.items())
    assert hit >= 0.98 * len(plain) and set(got) <= set(plain)
    assert "none" not in got and "null" not in got and "empty" not in got and got["lower"]["score"] == 100 and got["lower"]["pos"] == 100
    for name, x in got.items():
        text = dict(reads)[name].upper()
        again = align(text[::-1].translate(TURN) if x["rev"] else text, contigs[x["chr"]][x["pos"] : x["end"]], CFG)
        assert again[0] == x["score"]
    assert got["rep"]["n_alternatives"] == 2 and got["rep"]["xa"].count(";") == 2 and got["rep"]["score"] == 120


def test_written_index_is_not_shuffled(spark, genome):
    contigs, reads = genome
    c = spark.createDataFrame(list(contigs.items()), "chr string, seq string")
    index = write_index(minimizer_index(contig_chunks(c, 128), 128), "minimizers_of_test", buckets=4)
    r = spark.createDataFrame([x for x in reads], "id string, seq string")
    one = {tuple(x) for x in chains(r, index, ["id"]).collect()}
    two = {tuple(x) for x in chains(r, minimizer_index(contig_chunks(c)), ["id"]).collect()}
    assert one == two and one
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = chains(r, index, ["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE minimizers_of_test")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(key") == 1  # the reads' minimizers alone


def test_edges(spark):
    none = spark.createDataFrame([], "id string, seq string")
    c = spark.createDataFrame([("c", "ACGTTGCAAGCTTAGGCTCAACGATCGATCGGATCTAGCTTACG" * 2)], "chr string, seq string")
    assert map_reads(none, c, ["id"], CFG).collect() == []
    assert map_reads(spark.createDataFrame([("a", "ACGTTGCAAGCTTAGGCTCAACGATCGATCGGATCTAGCTTACG")], "id string, seq string"), c.limit(0), ["id"], CFG).collect() == []
    ties = spark.createDataFrame([(1, "b", False, 5, 40, "9="), (1, "a", True, 9, 40, "9="), (1, "a", True, 3, 31, "8=1X"), (1, "z", True, 3, 29, "9="), (2, "a", False, 0, 30, "9=")], "id int, chr string, rev boolean, pos long, score int, cigar string")
    got = {r["id"]: (r["chr"], r["pos"], r["n_alternatives"], r["xa"]) for r in best_and_alternatives(ties, ["id"], 0.75).collect()}
    assert got == {1: ("a", 9, 2, "b,+6,9=,0;a,-4,8=1X,1;"), 2: ("a", 0, 0, "")}


@pytest.mark.parametrize("width", [64, 50, 1000])
def test_contig_minimizers_are_those_of_the_whole_contig_and_move_nothing(spark, width):
    rng = random.Random(12)
    contigs = [(f"c{n}", "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=n))) for n in (0, 5, 16, 63, 64, 65, 66, 80, 128, 131, 333)]
    frame = mapping.contig_minimizers(spark.createDataFrame(contigs, "chr string, seq string"), width)
    want = sorted((int(key), c, int(pos), bool(rev)) for c, s in contigs for key, pos, rev in zip(*mapping.minimizers(codes(s)), strict=True))
    assert sorted(tuple(r) for r in frame.collect()) == want
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [10**6, 0])
def test_windows_within_and_across_chunks(spark, monkeypatch, small):
    monkeypatch.setattr(mapping, "SMALL_READS", small)
    rng = random.Random(13)
    contig = "".join(rng.choices("ACGT", k=1200))
    reads = spark.createDataFrame([(p, contig[p : p + 90]) for p in (0, 100, 250, 290, 420, 1110)], "read int, seq string")
    got = mapping.map_reads(reads, spark.createDataFrame([("c", contig)], "chr string, seq string"), ["read"], width=300).collect()
    assert sorted((r.read, r.pos, r.end, r.score) for r in got) == [(p, p, p + 90, 90) for p in (0, 100, 250, 290, 420, 1110)]
