"""Calls: statistics, acceptance, pairing, duplicates, report."""

from __future__ import annotations

import bisect
import functools
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.config import JunctionConfig
from junctura.operators.align import spans_query, turned
from junctura.operators.ranges import union_all
from junctura.sources.shared import materialize

#: Calls with a free partner that tasks may pair turn by turn, in memory.
PAIR_ROWS = 200_000
#: Steps in a block of calls that a task pairs, and rows in it from which on there are fewer.
PAIR_STEPS, BLOCK_ROWS = 8, 1_000_000
#: Calls of a pair of contigs in a block whose calls are compared with those of another.
DUPLICATE_BLOCK = 256
#: Stretches of a sequence, and letters of each, that tell which calls to compare it with first.
PROBES, PROBE = 8, 12


def call_statistics(reads: DataFrame, edge: list[str], cfg: JunctionConfig) -> DataFrame:
    """Per edge: reads, summed score, mean score by aligned base on both sides, breakpoints, and spans as coverage.

    ``reads``: ``edge, frag_id`` and for the sides h and v ``_score, _begin, _end`` (on the reference) ``, _len`` (query).
    """
    span = {s: F.max(f"{s}_end") - F.min(f"{s}_begin") for s in "hv"}
    return reads.groupBy(*edge).agg(
        F.count("*").alias("reads"),
        F.sum(F.col("h_score") + F.col("v_score")).cast("long").alias("score"),
        F.avg(F.col("h_score") / F.col("h_len")).alias("host_pbs"),
        F.avg(F.col("v_score") / F.col("v_len")).alias("virus_pbs"),
        F.max("h_end").alias("h_bp"),
        F.min("v_begin").alias("v_bp"),
        (span["h"] / F.lit(float(cfg.max_is - cfg.min_aligned))).alias("host_cov"),
        (span["v"] / F.lit(float(cfg.max_is))).alias("virus_cov"),
    )


def accept_calls(calls: DataFrame, cfg: JunctionConfig, accept_clipped: bool = False) -> DataFrame:
    """``calls`` with ``accepted``.

    Needs the host score by base, enough pairs (one less with a split read) and both consensus sequences to be half a
    read long; coverage with more than two pairs, or clipped reads if asked for, overrule that; masked sequences reject.
    """
    pairs, split = F.col("good_pairs"), F.col("split_reads")
    enough = (pairs >= cfg.min_pairs) | ((pairs == cfg.min_pairs - 1) & (split > 0))
    half = cfg.read_len // 2
    good = (F.col("host_pbs") >= cfg.min_host_pbs) & enough & (F.col("host_len") >= half) & (F.col("virus_len") >= half)
    covered = ((F.col("host_cov") + F.col("virus_cov")) / 2 >= cfg.min_coverage) & (pairs > 2)
    clipped = F.lit(accept_clipped) & (split > 0)

    def masked(side: str) -> Column:
        return (F.col(f"{side}_len") > 0) & (F.col(f"{side}_masked") > cfg.max_masked * F.col(f"{side}_len"))

    return calls.withColumn("accepted", (good | covered | clipped) & ~masked("host") & ~masked("virus"))


def adjust_coverage(calls: DataFrame, measured: DataFrame) -> DataFrame:
    """``calls`` with coverages raised to what was measured (``call_id, m_host, m_virus``), where that is larger."""
    both = calls.join(measured, "call_id", "left")
    raised = {f"{s}_cov": F.greatest(f"{s}_cov", F.coalesce(f"m_{s}", F.lit(0.0))) for s in ("host", "virus")}
    return both.withColumns(raised).drop("m_host", "m_virus")


def nearest_mates(calls: DataFrame, cfg: JunctionConfig) -> DataFrame:
    """``call_id, mate_id, dist``: each call's nearest partner, the smaller id of equally near ones; calls without are left out.

    Calls of one place and strand have the same nearest partner, so the places are looked at and not the calls: those of
    both strands are laid side by side in bins, with copies of those that the neighbouring bins can reach, and the nearest
    place of the other strand on either side is the last one seen going up or down. No pair that isn't the nearest is
    made, and a bin holds its places once, however many calls lie there.
    """
    low, high = cfg.pair_band
    reach = max(abs(low), abs(high))
    width = 8 * reach
    at, rev = F.col("host_pos"), F.col("host_rev")
    bins = F.sequence(F.floor((at - reach) / width), F.floor((at + reach) / width))
    place = ["host_chr", "host_rev", "host_pos"]
    known = calls.where(at.isNotNull() & rev.isNotNull()).select(*place, "call_id")
    rows = known.groupBy(*place).agg(F.min("call_id").alias("id")).select(*place, "id", F.explode(bins).alias("bin"))
    within = Window.partitionBy("host_chr", "bin")
    up, down = (within.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (at.asc(), at.desc()))

    def last(of_rev: bool) -> Column:
        return F.max(F.when(rev == F.lit(of_rev), F.struct(at.alias("at"), "id"))).over(up)

    def first(of_rev: bool) -> Column:
        return F.min(F.when(rev == F.lit(of_rev), F.struct(at.alias("at"), "id"))).over(down)

    seen = rows.select("*", F.when(rev, last(False)).otherwise(last(True)).alias("b"), F.when(rev, first(False)).otherwise(first(True)).alias("a"))

    def candidate(found: Column) -> Column:
        dist = F.when(rev, at - found["at"]).otherwise(found["at"] - at)
        return F.when(dist.between(low, high), F.struct(F.abs(dist).alias("far"), found["id"].alias("mate_id"), dist.alias("dist")))

    near = seen.where(F.col("bin") == F.floor(at / width)).select(*place, F.least(candidate(F.col("b")), candidate(F.col("a"))).alias("m"))
    return known.join(near.where("m IS NOT NULL"), place).select("call_id", "m.mate_id", "m.dist")


def pair_calls(calls: DataFrame, cfg: JunctionConfig) -> DataFrame:
    """``call_id, paired_with``: greedy one-to-one pairing; accepted calls first among themselves, then with rejected ones.

    Calls take turns by id and choose their nearest free partner, of equally near ones the smaller id; in the second part
    it is the accepted calls that choose. Candidate pairs are never made. While more than PAIR_ROWS calls have a free
    partner, contigs are cut into blocks, and a task takes the turns of one block and of what surrounds it; it keeps the
    pairs that are the same whatever happens beyond. Taking these out changes no other call's choice, so the next round
    goes on with the rest, its blocks moved by half. The turn that comes first is settled in any round, most others in the
    first one. A task a contig takes the turns of those left, which are PAIR_ROWS at most.
    """
    ids = F.col("call_id").cast("long")
    pool = calls.select(F.struct("host_chr", F.lit(False).alias("part")).alias("host_chr"), "host_rev", ids.alias("call_id"), F.col("host_pos").cast("long").alias("host_pos"), F.col("accepted").alias("turn"))
    pool, done = materialize(pool, "pair-pool"), []
    for late in (False, True):
        part, rounds = pool if late else pool.where("turn"), 0
        if late:
            # Each accepted call with the rejected ones of the other strand, in two parts that do not touch.
            part = pool.withColumn("host_chr", F.struct(F.col("host_chr.host_chr").alias("host_chr"), (F.col("turn") == F.col("host_rev")).alias("part")))
        while True:
            part = materialize(part.join(nearest_mates(part, cfg).select("call_id"), "call_id", "left_semi"), "pair-candidates")
            if part.limit(PAIR_ROWS + 1).count() <= PAIR_ROWS:
                done.append(materialize(_pairs_in_blocks(part.withColumn("block", F.lit(0).cast("long")), cfg.pair_band), "pairs"))
                break
            done.append(materialize(_settled_pairs(part, cfg.pair_band, rounds % 2 == 1), "pairs"))
            part, rounds = part.join(_both(done[-1]), "call_id", "left_anti"), rounds + 1
        if not late:
            pool = materialize(pool.join(_both(union_all(*done)), "call_id", "left_anti"), "pair-pool")
    pairs = union_all(*done)
    return pairs.toDF("call_id", "paired_with").unionByName(pairs.select(F.col("b").alias("call_id"), F.col("a").alias("paired_with")))


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("call_id"))


def _settled_pairs(part: DataFrame, band: tuple[int, int], moved: bool) -> DataFrame:
    """``a, b``: pairs that are sure from the calls around them, by blocks with two steps of their surroundings on either side.

    A step is as long as two calls can be apart, twice; blocks have as many steps as the densest step allows, two at least.
    """
    reach = max(map(abs, band))
    step = 2 * reach
    at = F.col("host_pos")
    densest = part.groupBy("host_chr", F.floor(at / step)).count().agg(F.max("count")).first()[0]
    width = step * max(2, min(PAIR_STEPS, BLOCK_ROWS // densest))
    start, halo = (width // 2 if moved else 0), 2 * step
    blocks = F.sequence(F.floor((at - start - halo) / width), F.floor((at - start + halo) / width))
    return _pairs_in_blocks(part.withColumn("block", F.explode(blocks)), band, (start, width, halo - reach))


def _pairs_in_blocks(rows: DataFrame, band: tuple[int, int], cut: tuple[int, int, int] | None = None) -> DataFrame:
    """``a, b``: pairs of each ``block``; with ``cut`` (where blocks begin, their width, how far around them no call beyond
    what the task has can reach) the sure ones whose chooser lies in the block itself."""

    def pair(table: pa.Table) -> pa.Table:
        ids, rev, place, turn = (table.column(c).to_numpy() for c in ("call_id", "host_rev", "host_pos", "turn"))
        rev, turn, sure, own = rev.astype(bool), turn.astype(bool), np.ones(len(ids), bool), np.ones(len(ids), bool)
        if cut:
            first = cut[0] + table.column("block")[0].as_py() * cut[1]
            sure = (place >= first - cut[2]) & (place < first + cut[1] + cut[2])
            own = (place >= first) & (place < first + cut[1])
        found = _take_turns(ids, rev, place, turn, sure, own, band)
        return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})

    flat = rows.select(F.col("host_chr.host_chr").alias("contig"), F.col("host_chr.part").alias("part"), "block", "call_id", "host_rev", "host_pos", F.coalesce("turn", F.lit(False)).alias("turn"))
    return flat.groupBy("contig", "part", "block").applyInArrow(pair, "a long, b long")


class _Free:
    """The calls of one strand in the order of place and id; those that are gone are skipped by halving paths."""

    def __init__(self, places: list[int], ids: list[int], there: np.ndarray):
        self.places, self.ids = places, ids
        self.up, self.down = array("q", range(len(ids) + 1)), array("q", range(len(ids) + 1))  # down: of k - 1, shifted by one
        for k in np.flatnonzero(~there).tolist():
            self.take(k)

    @staticmethod
    def _root(parents: array, k: int) -> int:
        while parents[k] != k:
            parents[k] = parents[parents[k]]
            k = parents[k]
        return k

    def take(self, k: int) -> None:
        self.up[k], self.down[k + 1] = k + 1, k

    def nearest(self, place: int, low: int, high: int) -> tuple[int, int, int] | None:
        """Distance, id and number of the nearest call from ``low`` to ``high``, of equally near ones the smallest id."""
        k, out = bisect.bisect_left(self.places, place), None
        right = self._root(self.up, k)
        if right < len(self.ids) and self.places[right] <= high:
            out = (self.places[right] - place, self.ids[right], right)
        left = self._root(self.down, k) - 1
        if left >= 0 and self.places[left] >= low:
            first = self._root(self.up, bisect.bisect_left(self.places, self.places[left]))
            other = (place - self.places[first], self.ids[first], first)
            out = min(out, other) if out else other
        return out


def _take_turns(ids: np.ndarray, rev: np.ndarray, place: np.ndarray, turn: np.ndarray, sure: np.ndarray, own: np.ndarray, band: tuple[int, int]) -> list[tuple[int, int]]:
    """Pairs of calls turn by turn: those that hold whatever becomes of the calls that aren't ``sure``, and whose chooser is ``own``.

    A call that isn't sure may have been taken by its turn or not. It makes unsure the nearest sure partner that it may
    take, as does a sure call that may take an unsure one instead. Behind its turn a call is gone: it is paired, or has no
    free partner left that could still choose it.
    """
    strands, at = {}, np.zeros(len(ids), np.int64)
    for side in (True, False):
        mine = np.flatnonzero(rev == side)
        mine = mine[np.lexsort((ids[mine], place[mine]))]
        at[mine] = np.arange(len(mine))
        places, names = place[mine].tolist(), ids[mine].tolist()
        strands[side] = (_Free(places, names, np.ones(len(mine), bool)), _Free(places, names, sure[mine]), bytearray(sure[mine].tobytes()), bytearray(len(mine)))
    out = []
    turns = np.flatnonzero(turn)
    turns = turns[np.argsort(ids[turns], kind="stable")]
    for call, side, here, k, mine in zip(ids[turns].tolist(), rev[turns].tolist(), place[turns].tolist(), at[turns].tolist(), own[turns].tolist(), strict=True):
        free, firm, known, gone = strands[side]
        if gone[k]:
            continue
        others, firm_others, known_others, gone_others = strands[not side]
        span = (here - band[1], here - band[0]) if side else (here + band[0], here + band[1])
        partner = firm_others.nearest(here, *span)
        if partner:
            other = partner[2]
            firm_others.take(other)
            if known[k] and others.nearest(here, *span) == partner:
                others.take(other)
                gone_others[other] = 1
                if mine:
                    out.append((call, partner[1]))
            else:
                known_others[other] = 0
        gone[k] = 1
        free.take(k)
        firm.take(k)
    return out


def duplicate_calls(calls: DataFrame, cfg: JunctionConfig) -> DataFrame:
    """``call_id`` of calls whose sequences an earlier call has on both sides.

    ``calls``: ``call_id, host_chr, virus_chr, host_rev, virus_rev, host_seq, virus_seq``. The shorter sequence is aligned
    to the longer, turned where the strands differ, and has to lie in it for ``duplicate_span`` of its length. Calls are
    compared within their pair of contigs; empty sequences are never duplicates.

    Calls with the same sequences and strands are compared once, for the first of them. All others of a pair of contigs meet,
    dealt into blocks of about ``DUPLICATE_BLOCK``; two blocks are one group, in which each looks for one earlier of the other.
    """
    spark, keys = calls.sparkSession, ["host_chr", "virus_chr"]
    cols = ["host_rev", "virus_rev", "host_seq", "virus_seq"]
    given = materialize(calls.where("host_seq <> '' AND virus_seq <> ''").select("call_id", *keys, *cols), "calls")
    kinds = given.groupBy(*keys, *cols).agg(F.min("call_id").alias("first"), F.max("call_id").alias("last"))
    sizes = kinds.groupBy(*keys).agg(F.ceil(F.count("*") / DUPLICATE_BLOCK).cast("int").alias("blocks"))
    dealt = kinds.join(sizes, keys).withColumn("block", F.expr("CAST(pmod(xxhash64(first), blocks) AS INT)"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    # A given number of partitions, as few bytes are much work.
    met = met.drop("blocks", "other").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "low", "high")
    types = {c: given.schema[c].dataType.simpleString() for c in (*keys, "call_id")}
    told = f"{', '.join(f'{c} {types[c]}' for c in keys)}, first {types['call_id']}, since {types['call_id']}"
    found = met.groupBy(*keys, "low", "high").applyInArrow(_earlier_duplicates(cfg), told).groupBy(*keys, "first").agg(F.min("since").alias("since"))
    late = kinds.join(found, [*keys, "first"]).select(*[F.col(c).alias(f"k_{c}") for c in (*keys, *cols)], "since")  # a kind is told by its first call
    same_kind = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in (*keys, *cols)]
    return given.join(late, same_kind).where("call_id > since").select("call_id").distinct()


def _earlier_duplicates(cfg: JunctionConfig):
    """``first, since`` of the kinds of two blocks that calls behind ``since`` are duplicates of: of any that comes before all of
    a kind's calls, or else of the first one. Kinds of one block are compared where it is met by itself."""

    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by("first")
        kinds = [_Kind(*row) for row in zip(*[table.column(c).to_pylist() for c in _Kind._fields], strict=True)]
        alone = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        since: dict[int, int] = {}

        def settle(pairs: list[tuple[int, int]]) -> None:
            for k, e in zip(*np.array(pairs)[_duplicates([(kinds[e], kinds[k]) for k, e in pairs], cfg)].T.tolist(), strict=True) if pairs else ():
                since[k] = min(since.get(k, e), e)

        turn, likely, others = 1, {}, {}
        for k, late in enumerate(kinds):
            ranked = [(-_common(*_hosts(kinds[e], late)), e) for e in range(k) if alone or kinds[e].block != late.block]
            likely[k] = [e for shared, e in sorted(ranked) if -2 * shared >= PROBES]
            others[k] = [e for shared, e in ranked if -2 * shared < PROBES]
        while any(likely.values()):
            settle([(k, e) for k, ranked in likely.items() for e in ranked[:turn]])
            likely, turn = {k: ranked[turn:] for k, ranked in likely.items() if k not in since}, 2 * turn
        settle([(k, e) for k, rest in others.items() if k not in since for e in rest])
        more = [k for k, kind in enumerate(kinds) if k not in since and kind.first < kind.last]
        settle([(k, k) for k in more])
        settle([(k, e) for k in more if k not in since for e in range(k + 1, len(kinds)) if kinds[e].first < kinds[k].last and (alone or kinds[e].block != kinds[k].block)])
        contigs = {c: pa.array([table.column(c)[0].as_py()] * len(since), table.schema.field(c).type) for c in ("host_chr", "virus_chr")}
        ids = {"first": list(since), "since": list(since.values())}
        return pa.table(contigs | {c: pa.array([kinds[k].first for k in of], table.schema.field("first").type) for c, of in ids.items()})

    return find


class _Kind(NamedTuple):
    """Calls with the same sequences and strands, and their block."""

    block: int
    host_rev: bool
    virus_rev: bool
    host_seq: str
    virus_seq: str
    first: int
    last: int


def _duplicates(pairs: list[tuple[_Kind, _Kind]], cfg: JunctionConfig) -> np.ndarray:
    """Whether of each pair of kinds, early and late, both sides are the same; the virus is looked at where the host is."""
    out = spans_query([_hosts(*pair) for pair in pairs], cfg.duplicate_span, cfg)
    left = np.flatnonzero(out)
    out[left] = spans_query([_shorter_first(e.virus_seq, k.virus_seq, e.virus_rev, k.virus_rev) for e, k in (pairs[x] for x in left.tolist())], cfg.duplicate_span, cfg)
    return out


def _hosts(early: _Kind, late: _Kind) -> tuple[str, str]:
    return _shorter_first(early.host_seq, late.host_seq, early.host_rev, late.host_rev)


def _common(query: str, ref: str) -> int:
    """How many of PROBES stretches of the query are in the reference."""
    return sum(s in ref for s in _probes(query))


@functools.lru_cache(4 * DUPLICATE_BLOCK)
def _probes(query: str) -> list[str]:
    return [query[at : at + PROBE] for at in ((len(query) - PROBE) * k // (PROBES - 1) for k in range(PROBES)) if at >= 0]


def _shorter_first(early: str, late: str, early_rev: bool, late_rev: bool) -> tuple[str, str]:
    """Query and reference: the shorter one, turned where strands differ, and the longer; of one length, the later and the earlier."""
    query, ref = (late, early) if len(early) >= len(late) else (early, late)
    return (_turned(query) if {early_rev, late_rev} == {False, True} else query), ref


_turned = functools.lru_cache(4 * DUPLICATE_BLOCK)(turned)


def last_masks(masks: DataFrame, order: str = "ord") -> DataFrame:
    """``call_id, side, start, end``: of several rows of a sequence the last one, as masks are read by name."""
    latest = masks.groupBy("call_id", "side").agg(F.max_by(F.struct("start", "end"), order).alias("m"))
    return latest.select("call_id", "side", "m.start", "m.end")


def with_sequences_and_masks(calls: DataFrame, sequences: DataFrame, masks: DataFrame) -> DataFrame:
    """``calls`` with ``host_len, virus_len, host_masked, virus_masked``, 0 where a call has no sequence or no mask.

    ``sequences``: ``call_id, side ('host' or 'virus'), seq``; ``masks``: ``call_id, side, start, end``, summed by their union.
    """
    lengths = sequences.select("call_id", "side", F.length("seq").cast("long").alias("len"))
    facts = lengths.join(masked_lengths(masks), ["call_id", "side"], "full")
    sides = [F.max(F.when(F.col("side") == s, F.coalesce(c, F.lit(0)))).alias(f"{s}_{n}") for s in ("host", "virus") for c, n in (("len", "len"), ("masked", "masked"))]
    each = facts.groupBy("call_id").agg(*sides)
    names = [f"{s}_{n}" for s in ("host", "virus") for n in ("len", "masked")]
    return calls.join(each, "call_id", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def reported(calls: DataFrame, rejected: bool = False) -> DataFrame:
    """The calls to report: accepted ones, or ``rejected`` ones, that aren't removed as duplicates (column ``removed``)."""
    return calls.where((F.col("accepted") != F.lit(rejected)) & ~F.coalesce("removed", F.lit(False)))


def masked_lengths(masks: DataFrame) -> DataFrame:
    """``call_id, side, masked``: bases under the union of a sequence's masked spans (``start, end``)."""
    from junctura.operators.ranges import merged

    return merged(masks, ["call_id", "side"], "start", "end").groupBy("call_id", "side").agg(F.sum(F.col("end") - F.col("start")).alias("masked"))


def raw_line(c: str = "") -> Column:
    """A call as a line of 13 fields."""
    place = [F.concat_ws(":", F.col(f"{s}_chr"), F.when(F.col(f"{s}_rev"), "-").otherwise("+"), F.col(f"{s}_start").cast("string"), F.col(f"{s}_end").cast("string")) for s in ("host", "virus")]
    numbers = [F.col(n).cast("string") for n in ("reads", "good_pairs", "split_reads", "score")]
    shares = [F.format_string("%.6f", n) for n in ("host_pbs", "virus_pbs")]
    more = [F.col(n).cast("string") for n in ("reads_w_dups", "unique_reads_w_dups")]
    cover = [F.format_string("%.6f", n) for n in ("host_cov", "virus_cov")]
    return F.concat_ws(" ", F.col("call_id").cast("string"), *place, *numbers, *shares, *more, *cover)


def report_line() -> Column:
    """A call for people: 1-based places, the reversed breakpoint at its start."""

    def place(s: str) -> Column:
        rev = F.col(f"{s}_rev")
        return F.concat(F.col(f"{s}_chr"), F.lit(":"), F.when(rev, "-").otherwise("+"), F.when(rev, F.col(f"{s}_start")).otherwise(F.col(f"{s}_end")).cast("string"))

    cover = F.format_string("%.6f", (F.col("host_cov") + F.col("virus_cov")) / 2)
    paired = F.when(F.col("paired_with").isNotNull(), F.concat(F.lit(" PAIRED WITH ID="), F.col("paired_with").cast("string"))).otherwise("")
    return F.concat(
        F.lit("ID="), F.col("call_id").cast("string"), F.lit(" "), place("host"), F.lit(" "), place("virus"), F.lit(" SUPPORTING_PAIRS="), F.col("good_pairs").cast("string"),
        F.lit(" SPLIT_READS="), F.col("split_reads").cast("string"), F.lit(" HOST_PBS="), F.format_string("%.6f", "host_pbs"), F.lit(" COVERAGE="), cover, paired,
    )
