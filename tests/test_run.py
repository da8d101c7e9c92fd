"""The whole job over planted junctions: it finds them, and no others; and it goes on where it ended."""

import random
from dataclasses import replace

import pytest

from junctura.config import JunctionConfig
from junctura.run import numbered, run
from junctura.sources.stages import Stages

CFG = replace(JunctionConfig(), read_len=100)
READS = "read_id string, seg int, seq string"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def fragments(rng, source, starts, name):
    out = []
    for k, start in enumerate(starts):
        f = source[start : start + 300]
        pair = [(f"{name}{k}", 1, f[:100]), (f"{name}{k}", 2, rc(f[-100:]))]
        out += pair if rng.random() < 0.5 else [(r, 3 - seg, s) for r, seg, s in pair]  # either strand of the fragment is sequenced
    return out


@pytest.fixture(scope="module")
def planted():
    """Host up to 2000 joined to the virus from 300 on, and the virus up to 900 joined to the host from 5000 on."""
    rng = random.Random(11)
    host, virus = ("".join(rng.choices("ACGT", k=n)) for n in (8_000, 1_200))
    one, two = host[:2_000] + virus[300:], virus[:900] + host[5_000:]
    reads = fragments(rng, one, range(1_704, 1_996, 6), "a") + fragments(rng, two, range(604, 896, 6), "b")
    reads += fragments(rng, host, [rng.randint(0, 7_600) for _ in range(60)], "h") + fragments(rng, virus, [rng.randint(0, 850) for _ in range(20)], "v")
    reads += [("a3", 1, None), ("odd", 1, ""), ("odd", 2, "ACGT"), ("alone", 1, virus[100:200])]
    return host, virus, reads


def test_planted_junctions_are_found(spark, planted, tmp_path):
    host, virus, rows = planted
    given = [spark.createDataFrame([r for r in rows if r[:2] != ("a3", 1)], READS), spark.createDataFrame([("chrA", host)], "chr string, seq string"), spark.createDataFrame([("virX", virus)], "chr string, seq string")]
    folder = f"file://{tmp_path}/job"
    report = run(spark, *given, folder, CFG, width=512)
    called = {r["call_id"]: r for r in report.called.collect()}
    accepted = {r["call_id"]: r["line"] for r in report.accepted.collect()}
    places = sorted((called[c]["host_chr"], called[c]["host_pos"], called[c]["virus_pos"]) for c in accepted)
    assert len(places) == 2
    (_, h1, v1), (_, h2, v2) = places
    assert abs(h1 - 2_000) <= 5 and abs(v1 - 300) <= 5 and abs(h2 - 5_000) <= 5 and abs(v2 - 900) <= 5
    assert all(called[c]["good_pairs"] >= 10 and called[c]["split_reads"] > 0 for c in accepted)
    for c in accepted:
        own = called[c]
        assert own["host_seq"] in host or own["host_seq"] in rc(host)
        assert own["virus_seq"] in virus or own["virus_seq"] in rc(virus)
    assert report.rejected.count() + len(accepted) + sum(r["removed"] for r in called.values()) == len(called) == report.remapped.count()
    first = list(report.made)
    assert "screened" in first and "called" in first
    again = run(spark, *given, folder, CFG, width=512)
    assert again.made == [] and {r["line"] for r in again.accepted.collect()} == set(accepted.values())
    other = run(spark, *given, folder, replace(CFG, min_pairs=1_000, min_coverage=2.0), width=512)
    assert other.accepted.count() == 0 and other.made == ["called"]


def test_nothing_to_find(spark, planted, tmp_path):
    host, virus, rows = planted
    refs = [spark.createDataFrame([(n, t)], "chr string, seq string") for n, t in (("chrA", host), ("virX", virus))]
    reads = [r for r in rows if r[0][0] in "hv"] + [("n", 1, None), ("n", 2, "")]
    report = run(spark, spark.createDataFrame(reads, READS), *refs, f"file://{tmp_path}/none", CFG)
    assert report.called.count() == report.accepted.count() == report.rejected.count() == 0


def test_stages_are_made_once_and_again_when_what_they_are_made_of_changes(spark, tmp_path):
    def job(rows, setting, fail=False):
        s = Stages(spark, f"file://{tmp_path}/s")
        given = s.given(spark.createDataFrame(rows, "x int, y string"))
        double = s.stage("double", lambda: given.selectExpr("x * 2 AS x"), given)

        def more():
            if fail:
                raise RuntimeError("lost")
            return double.selectExpr(f"x + {setting} AS x")

        return sorted(r.x for r in s.stage("more", more, double, settings=setting).collect()), s.made

    rows = [(1, "a"), (2, None)]
    with pytest.raises(RuntimeError):
        job(rows, 1, fail=True)
    assert job(rows, 1) == ([3, 5], ["more"])
    assert job(rows[::-1], 1) == ([3, 5], [])
    assert job(rows, 7) == ([9, 11], ["more"])
    assert job([*rows, (2, None)], 7) == ([9, 11, 11], ["double", "more"])
    assert sorted(tuple(r) for r in numbered(spark.createDataFrame([(k * 7 % 50,) for k in range(50)], "a int").repartition(6), ["a"], "n").collect()) == [(k, k) for k in range(50)]
