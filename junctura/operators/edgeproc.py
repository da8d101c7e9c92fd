"""Consensus, duplicates and packing of edges' reads."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from junctura.config import JunctionConfig
from junctura.functions.sequences import consistent_cigars, is_low_complexity, left_clip, right_clip
from junctura.operators.ranges import union_all
from junctura.sources.shared import materialize

#: Rows of one component that a task may pack in memory, and reads of one edge that it may go through in order.
PACK_ROWS, DEDUP_ROWS = 200_000, 200_000
#: Columns of sequences that are counted together; the place of rows that have none.
STRETCH, _LAST = 1024, (1 << 63) - 1


def consensus(rows: DataFrame, by: list[str], order: str, seq: str = "seq") -> DataFrame:
    """``by, consensus``: the majority letter of each column of sequences that start together.

    N never wins unless nothing else stands in the column; of letters that are equally frequent the one wins that
    reached the count first in the order given, a number. Sequences are moved once, in stretches of columns, and a task
    goes through those of a group as they come and keeps its counts alone, so no group is gathered.
    """
    pieces = rows.where(F.length(seq) > 0).select(*by, F.coalesce(F.col(order).cast("long"), F.lit(_LAST)).alias("__order"), F.col(seq).alias("__seq"))
    stretches = F.sequence(F.lit(0).cast("long"), F.floor((F.length("__seq") - 1) / STRETCH).cast("long"))
    pieces = pieces.select("*", F.explode(stretches).alias("__stretch"))
    pieces = pieces.select(*by, "__stretch", "__order", F.substring("__seq", (F.col("__stretch") * STRETCH + 1).cast("int"), F.lit(STRETCH)).alias("__piece"))
    keys = [*by, "__stretch"]
    schema = T.StructType([*(pieces.schema[k] for k in keys), T.StructField("__piece", T.StringType())])
    parts = pieces.repartition(*keys).sortWithinPartitions(*keys, "__order").mapInArrow(lambda batches: _majorities(batches, keys), schema)
    ordered = F.sort_array(F.collect_list(F.struct("__stretch", "__piece")))
    return parts.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["__piece"]), "").alias("consensus"))


def _majorities(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """``keys, __piece``: the majority letters of each run of rows with equal keys; runs may go on in the next batch."""
    kept: tuple | None = None  # the last run: its keys in a table of one row, its counts and last places by letter

    def flush(key: pa.Table, letters: list[str]) -> pa.RecordBatch:
        return pa.Table.from_arrays([*(c.combine_chunks() for c in key.columns), pa.array(letters, pa.string())], names=[*keys, "__piece"]).combine_chunks().to_batches()[0]

    for table in _slices(batches):
        n = len(table)
        starts = np.zeros(n, bool)
        starts[0] = True
        for k in keys:
            at = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts[1:] |= at[1:] != at[:-1]
        run = np.cumsum(starts) - 1
        firsts = np.flatnonzero(starts)
        heads = table.select(keys).take(pa.array(firsts))
        texts = table.column("__piece").to_pylist()
        lengths = np.fromiter(map(len, texts), np.int64, n)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        alphabet = np.unique(codes)
        widths = np.maximum.reduceat(lengths, firsts)
        goes_on = kept is not None and kept[0].to_pylist() == heads.slice(0, 1).to_pylist()
        if goes_on:
            alphabet = np.union1d(alphabet, np.array(list(kept[1]), np.uint32))
            widths[0] = max(widths[0], *(len(c) for c, _ in kept[1].values()))
        elif kept is not None:
            yield flush(kept[0], [_winners(kept[1])])
        base = np.concatenate([[0], np.cumsum(widths)])
        column = np.repeat(base[run] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(len(codes))
        cell = np.searchsorted(alphabet, codes) * base[-1] + column
        counts = np.bincount(cell, minlength=len(alphabet) * base[-1]).reshape(len(alphabet), -1)
        last = np.full(len(alphabet) * base[-1], -1 << 63, np.int64)
        last[cell] = np.repeat(table.column("__order").to_numpy(), lengths)  # rows come in order, so the last one stays
        last = last.reshape(len(alphabet), -1)
        if goes_on:
            for code, (c, at) in kept[1].items():
                x = int(np.searchsorted(alphabet, code))
                counts[x, : len(c)] += c
                last[x, : len(c)] = np.maximum(last[x, : len(c)], at)
        tally = {int(code): (counts[x], last[x]) for x, code in enumerate(alphabet)}
        letters = _winners(tally)
        if len(firsts) > 1:
            yield flush(heads.slice(0, len(firsts) - 1), [letters[base[r] : base[r + 1]] for r in range(len(firsts) - 1)])
        kept = heads.slice(len(firsts) - 1), {code: (c[base[-2] :].copy(), at[base[-2] :].copy()) for code, (c, at) in tally.items()}
    if kept is not None:
        yield flush(kept[0], [_winners(kept[1])])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in slices of about a million letters."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        step = max(1, int(len(table) * 1_000_000 / max(1, table.column("__piece").nbytes)))
        for at in range(0, len(table), step):
            yield table.slice(at, step)


def _winners(tally: dict) -> str:
    """The letter of each column with the highest count, of equal ones the one that was last seen earliest."""
    width = len(next(iter(tally.values()))[0])
    top, since, letter = np.zeros(width, np.int64), np.zeros(width, np.int64), np.full(width, ord("N"), np.uint32)
    for code in sorted(tally):
        n, last = tally[code]
        n = np.minimum(n, 1) if code == ord("N") else np.where(n > 0, n + 1, 0)
        better = (n > top) | ((n == top) & (n > 0) & (last <= since))
        top, since, letter = np.where(better, n, top), np.where(better, last, since), np.where(better, np.uint32(code), letter)
    return letter.astype("<u4").tobytes().decode("utf-32-le")


def differences(row: Column, agreed: Column) -> Column:
    """Letters of a row that differ from a consensus, N in either counting as equal."""

    @F.pandas_udf("int")
    def count(rows: pd.Series, consensuses: pd.Series) -> pd.Series:
        out: list[int | None] = []
        for a, b in zip(rows, consensuses, strict=True):
            if a is None or b is None:
                out.append(None)
                continue
            x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
            m = min(len(x), len(y))
            differ = (x[:m] != y[:m]) & (x[:m] != ord("N")) & (y[:m] != ord("N"))
            out.append(int(differ.sum()) + int((x[m:] != ord("N")).sum()))
        return pd.Series(out, dtype="Int32")

    return count(row, agreed)


def difference_counts(rows: DataFrame, agreed: DataFrame, by: list[str], order: str, seq: str = "seq") -> DataFrame:
    """``by, order, diffs``: columns in which a row differs from its group's consensus, N in either counting as equal."""
    return rows.join(agreed, by).select(*by, order, differences(F.col(seq), F.col("consensus")).alias("diffs"))


def split_edge(labels: list, seqs: list[str], mates: dict, split: set, cfg: JunctionConfig) -> list[set]:
    """The reads of an edge as consistent subsets: the edge itself first, then what was split off.

    Rows that differ from the consensus in ``diff_rate`` of their letters leave for a new edge, together with all rows
    after them that agree with them; the new edge is split in turn while it is large enough and shrinks.
    """

    def enough(reads: set) -> bool:
        weight = sum(0.5 if mates.get(x) in reads else 1.0 for x in reads)
        return weight + (1 if reads & split else 0) >= cfg.edge_reads

    parent, parts = set(labels), []
    current, rows = parent, list(range(len(labels)))
    width = max(map(len, seqs), default=0)
    grid = np.array([list(s.ljust(width, "N")) for s in seqs]).reshape(len(seqs), width)
    while rows:
        block = grid[rows]
        filled = (block != "N").sum(1)
        majority = np.full(width, "N")
        for c in range(width):
            tally: dict[str, int] = {}
            top = 0
            for letter in block[:, c]:
                if letter != "N":
                    tally[letter] = tally.get(letter, 0) + 1
                    if tally[letter] > top:
                        top, majority[c] = tally[letter], letter
        diffs = ((block != majority) & (block != "N") & (majority != "N")).sum(1)
        leaving = [k for k in range(len(rows)) if filled[k] and diffs[k] / filled[k] >= cfg.diff_rate]
        if not leaving:
            break
        child = set()
        for k in leaving:
            current.discard(labels[rows[k]])
            child.add(k)
            for other in range(k + 1, len(rows)):
                x, y = block[k], block[other]
                if not ((x != y) & (x != "N") & (y != "N")).any():
                    child.add(other)
        new = {labels[rows[k]] for k in child}
        if not enough(new):
            break
        parts.append(new)
        if len(child) >= len(rows):
            break
        rows, current = [rows[k] for k in sorted(child)], new
    return [parent, *(p for p in parts if enough(p))]


def split_edges(rows: DataFrame, edge: list[str], cfg: JunctionConfig | None = None) -> DataFrame:
    """``edge, part, frag_id``: ``split_edge`` for every edge; part 0 is the edge itself, others what was split off.

    ``rows``: ``edge, frag_id, seq``, and where there are split reads ``read_id, is_split`` as in ``pack_edges``; an edge's
    sequences start together. A round splits all edges that are still open: letters are counted by column, rows that leave
    are joined with the later rows of their edge, and nothing is gathered by edge.
    """
    cfg = cfg or JunctionConfig()
    split, unit = F.lit(False), F.concat(F.lit("f"), F.col("frag_id").cast("string"))
    if {"read_id", "is_split"} <= set(rows.columns):
        split = F.coalesce("is_split", F.lit(False))
        unit = F.when(split & F.col("read_id").isNotNull(), F.concat(F.lit("r"), F.col("read_id").cast("string"))).otherwise(unit)
    columns = [*edge, "frag_id", "seq", "is_split", "unit"]
    current = materialize(rows.select(*edge, "frag_id", F.coalesce("seq", F.lit("")).alias("seq"), split.alias("is_split"), unit.alias("unit")), "split-rows")

    def enough(part: DataFrame) -> DataFrame:
        weight = F.count_distinct("unit") + F.max(F.col("is_split").cast("int"))
        return part.groupBy(*edge).agg(weight.alias("w"), F.count("*").alias("n")).where(F.col("w") >= cfg.edge_reads)

    parts, level = [], 0
    while True:
        filled = F.length(F.replace("seq", F.lit("N"), F.lit("")))
        agreed = current.join(consensus(current, edge, "frag_id"), edge, "left").withColumn("diffs", differences(F.col("seq"), F.col("consensus")))
        marked = agreed.withColumn("leaves", (filled > 0) & (F.coalesce("diffs", F.lit(0)) / filled >= cfg.diff_rate))
        marked = materialize(marked.withColumn("leaves", F.coalesce("leaves", F.lit(False))).select(*columns, "leaves"), "split-marked")
        stays = marked.where("NOT leaves")
        if level:
            stays = stays.join(enough(stays).select(*edge), edge, "left_semi")
        parts.append(materialize(stays.select(*edge, F.lit(level).alias("part"), "frag_id"), "split-part"))
        leaving = marked.where("leaves").select(*edge, F.col("frag_id").alias("__id"), F.col("seq").alias("__seq"))
        mine, other = F.col("seq"), F.col("__seq")
        at = F.sequence(F.lit(1), F.greatest(F.least(F.length(mine), F.length(other)), F.lit(1)))

        def differs(p):
            x, y = F.substring(mine, p, F.lit(1)), F.substring(other, p, F.lit(1))
            return (x != y) & (x != "N") & (y != "N") & (x != "") & (y != "")

        plain = ~F.contains(mine, F.lit("N")) & ~F.contains(other, F.lit("N"))
        agree = F.when(plain, F.startswith(mine, other) | F.startswith(other, mine)).otherwise(~F.exists(at, differs))
        # Rows that leave agree with themselves.
        same = [F.col(c) == F.col(f"__{c}") for c in edge]
        named = leaving.withColumnsRenamed({c: f"__{c}" for c in edge})
        child = marked.join(named, reduce(Column.__and__, [*same, F.col("frag_id") >= F.col("__id"), agree]), "left_semi").select(*columns).distinct()
        child = materialize(child, "split-child")
        sizes = materialize(current.groupBy(*edge).agg(F.count("*").alias("before")).join(enough(child), edge).select(*edge, (F.col("n") < F.col("before")).alias("shrinks")), "split-sizes")
        level += 1
        # A new edge that is as large as the one it comes from is not split again.
        parts.append(child.join(sizes.where("NOT shrinks"), edge, "left_semi").select(*edge, F.lit(level).alias("part"), "frag_id"))
        current = materialize(child.join(sizes.where("shrinks"), edge, "left_semi").select(*columns), "split-rows")
        if not current.limit(1).count():
            return union_all(*parts)


def remove_duplicates(reads: DataFrame, edge: list[str], exploratory: bool = False) -> DataFrame:
    """``edge, frag_id, h_distal, v_distal`` without duplicates, as if an edge's reads were taken one by one by id.

    A read is a duplicate if a read that was kept has its distal end on the host side, or one has it on the virus side.
    exploratory: if only one side has been seen, the read is one only if its joint CIGAR (column ``joint``, see
    ``sequences.joint_cigar``) is consistent with that of a kept read there, from the side that has been seen on.

    Edges of up to DEDUP_ROWS reads are gone through in one task each. Larger ones are settled in rounds, in which the
    reads that are first at both their ends are decided by those kept before them.
    """
    columns = [*edge, "frag_id", "h_distal", "v_distal"]
    joint = F.col("joint") if exploratory else F.lit(None).cast("string").alias("joint")
    rows = materialize(reads.select(*columns, joint).distinct(), "undecided")
    sizes = rows.groupBy(*edge).agg(F.count("*").alias("n"))
    large = materialize(sizes.where(F.col("n") > DEDUP_ROWS).select(*edge), "large-edges")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def in_order(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("frag_id", kind="stable")
        kept = _first_seen(ordered["h_distal"].tolist(), ordered["v_distal"].tolist(), ordered["joint"].tolist() if exploratory else None)
        return ordered.loc[kept, columns]

    small = rows.join(large, edge, "left_anti").groupBy(*edge).applyInPandas(in_order, ", ".join(f"{c} {types[c]}" for c in columns))
    open_ = materialize(rows.join(large, edge, "left_semi"), "undecided")
    kept = []
    while open_.limit(1).count():
        first_h = open_.groupBy(*edge, "h_distal").agg(F.min("frag_id").alias("h_first"))
        first_v = open_.groupBy(*edge, "v_distal").agg(F.min("frag_id").alias("v_first"))
        first = open_.join(first_h, [*edge, "h_distal"]).join(first_v, [*edge, "v_distal"]).where("frag_id = h_first AND frag_id = v_first")
        turn = materialize(first.select(*columns, "joint"), "first-reads")
        if exploratory and kept:
            stay = turn.join(_duplicates_of(turn, union_all(*kept), edge), [*edge, "frag_id"], "left_anti")
        else:
            stay = turn
        stay = materialize(stay, "stay")
        kept.append(stay)
        rest = open_.join(turn.select(*edge, "frag_id"), [*edge, "frag_id"], "left_anti")
        if not exploratory:  # all others at these ends go at once
            rest = rest.join(stay.select(*edge, "h_distal"), [*edge, "h_distal"], "left_anti").join(stay.select(*edge, "v_distal"), [*edge, "v_distal"], "left_anti")
        open_ = materialize(rest.select(*columns, "joint"), "undecided")
    return union_all(small, *[part.select(*columns) for part in kept])


def _first_seen(host: list, virus: list, joint: list | None) -> np.ndarray:
    """Which of an edge's reads stay, taken in the order given."""
    kept = np.zeros(len(host), dtype=bool)
    on_host: dict = defaultdict(list)
    on_virus: dict = defaultdict(list)
    parts = [re.findall(r"\d+[A-Z=]", c or "") for c in joint] if joint else []

    def agree(a: list[str], b: list[str]) -> bool:
        return len(a) == len(b) and (not a or (a[:-1] == b[:-1] and a[-1][-1] == b[-1][-1]))

    for k, (h, v) in enumerate(zip(host, virus, strict=True)):
        seen_h, seen_v = h in on_host, v in on_virus
        if seen_h or seen_v:
            if joint is None or (seen_h and seen_v):
                continue
            others = on_host[h] if seen_h else on_virus[v]
            if any(agree(parts[o], parts[k]) if seen_h else agree(parts[o][::-1], parts[k][::-1]) for o in others):
                continue
        kept[k] = True
        on_host[h].append(k)
        on_virus[v].append(k)
    return kept


def _duplicates_of(turn: DataFrame, kept: DataFrame, edge: list[str]) -> DataFrame:
    """``edge, frag_id`` of reads that are duplicates of kept ones, in the exploratory way."""
    facts = []
    for side, back in (("h_distal", False), ("v_distal", True)):
        before = kept.select(*edge, side, F.col("joint").alias("other"))
        met = turn.join(before, [*edge, side]).groupBy(*edge, "frag_id").agg(F.bool_or(consistent_cigars(F.col("other"), F.col("joint"), F.lit(back))).alias("agrees"))
        facts.append(met.withColumn("side", F.lit(side)))
    each = facts[0].unionByName(facts[1]).groupBy(*edge, "frag_id").agg(F.count("*").alias("sides"), F.bool_or("agrees").alias("agrees"))
    return each.where("sides = 2 OR agrees").select(*edge, "frag_id")


def is_suspicious(is_virus: bool, side: str, cfg: JunctionConfig) -> Column:
    """Whether one side of a read's alignment can't be trusted.

    Columns, after ``side_``: ``seq`` (the segment as aligned), ``q_begin, q_end, ref`` (the region's sequence), ``begin, end,
    cigar`` and ``bp``, the edge's breakpoint in the region. It can't where the aligned part of read or region is of low
    complexity, or where the read is clipped at the junction by more than ``max_clip_distance`` and its alignment ends
    further than that from the breakpoint.
    """

    def c(name: str) -> Column:
        return F.col(f"{side}_{name}")

    low = is_low_complexity(c("seq"), c("q_begin"), c("q_end"), cfg.dinucleotide_share) | is_low_complexity(c("ref"), c("begin"), c("end"), cfg.dinucleotide_share)
    clip = left_clip(c("cigar")) if is_virus else right_clip(c("cigar"))
    miss = F.abs(c("bp") - (c("begin") if is_virus else c("end")))
    return low | ((clip > cfg.max_clip_distance) & (miss > cfg.max_clip_distance))


def without_suspicious(reads: DataFrame, cfg: JunctionConfig) -> DataFrame:
    """``reads`` without those of which either side is suspicious; null facts don't speak against a read."""
    return reads.where(~F.coalesce(is_suspicious(False, "h", cfg), F.lit(False)) & ~F.coalesce(is_suspicious(True, "v", cfg), F.lit(False)))


def with_parts(edge_reads: DataFrame, parts: DataFrame, edge: list[str]) -> DataFrame:
    """Edges and what was split off them as one table of edges: ``edge, part, ...``, a row for each part a read is in.

    ``parts``: ``edge, part, frag_id`` as from :func:`split_edges`; reads that no part names are left out.
    """
    return edge_reads.join(parts, [*edge, "frag_id"])


def within_insert_size(reads: DataFrame, max_is: int) -> DataFrame:
    """Reads whose ends are together at most ``max_is`` from the breakpoints (``h_bp, v_bp, h_distal, v_distal``)."""
    return reads.where(2 + F.abs(F.col("h_bp") - F.col("h_distal")) + F.abs(F.col("v_bp") - F.col("v_distal")) <= max_is)


def pack_component(edges: dict, unit: dict, split: set, need: float) -> dict:
    """Edges taken, with their reads: the highest score first (of equal ones the smaller key), each read once.

    ``edges``: key -> {read: score}; ``unit``: (key, read) -> unit, ``split``: the same pairs that are split. However many of
    its reads an edge has, a unit counts once, and all of it leaves with the edge that is taken. An edge whose remaining
    units are too few is dropped and its reads stay free.
    """
    by_unit = defaultdict(set)
    for key, reads in edges.items():
        for read in reads:
            by_unit[unit[key, read]].add((key, read))
    left = {key: dict(reads) for key, reads in edges.items()}
    queue = [(-sum(reads.values()), key) for key, reads in left.items()]
    heapq.heapify(queue)
    taken = {}
    while queue:
        score, key = heapq.heappop(queue)
        reads = left[key]
        now = -sum(reads.values())
        if now != score:
            if reads:
                heapq.heappush(queue, (now, key))
            continue
        units = {unit[key, r] for r in reads}
        gone = dict(left.pop(key))
        if len(units) + any((key, r) in split for r in gone) < need:
            continue
        taken[key] = gone
        for u in units:
            for other, read in by_unit.pop(u):
                if other in left:
                    left[other].pop(read, None)
    return taken


def pack_edges(reads: DataFrame, edge: list[str], cfg: JunctionConfig | None = None) -> DataFrame:
    """``edge, frag_id``: each fragment on one edge at most, the highest-scoring edges first.

    ``reads``: ``edge, frag_id, score``, and where there are split reads ``read_id, is_split``: two split fragments of one
    read are mates. All split fragments of a read are one unit, which counts once on an edge however many of them it has; an
    edge with a split fragment counts one more, and all of a taken edge's units leave the other edges. Edges that share no unit (a fragment, or a read's split fragments),
    directly or through others, are independent and are packed in parallel. While a component has more than PACK_ROWS
    rows it is worked down in rounds: an edge that scores highest for all of its units is taken or dropped now, as it
    would be before its neighbours anyway.
    """
    cfg = cfg or JunctionConfig()
    key = F.struct(*edge)
    split, unit = F.lit(False), F.concat(F.lit("f"), F.col("frag_id").cast("string"))
    if {"read_id", "is_split"} <= set(reads.columns):
        split = F.coalesce("is_split", F.lit(False))
        unit = F.when(split & F.col("read_id").isNotNull(), F.concat(F.lit("r"), F.col("read_id").cast("string"))).otherwise(unit)
    given = reads.select(key.alias("edge"), "frag_id", "score", split.alias("is_split"), unit.alias("unit"))
    columns = ["edge", "frag_id", "score", "is_split", "unit"]
    facts = [F.sum("score").alias("score"), F.bool_or("is_split").alias("is_split"), F.max("unit").alias("unit")]
    pool = materialize(given.groupBy("edge", "frag_id").agg(*facts), "edge-pool")
    done = []
    while True:
        component = _components(pool)
        sizes = component.groupBy("component").agg(F.count("*").alias("rows"))
        small = component.join(sizes.where(F.col("rows") <= PACK_ROWS), "component").select("component", *columns)

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            groups: dict = defaultdict(dict)
            units, halves = {}, set()
            for e, frag, score, unit, is_split in zip(rows["edge"], rows["frag_id"], rows["score"], rows["unit"], rows["is_split"], strict=True):
                at = tuple(e.values()) if isinstance(e, dict) else tuple(e)
                groups[at][frag], units[at, frag] = score, unit
                if is_split:
                    halves.add((at, frag))
            taken = pack_component(groups, units, halves, cfg.edge_reads)
            out = [(*e, frag) for e, found in taken.items() for frag in found]
            return pd.DataFrame(out, columns=[*edge, "frag_id"])

        fields = {f.name: f.dataType.simpleString() for f in reads.schema.fields}
        schema = ", ".join(f"{c} {fields[c]}" for c in [*edge, "frag_id"])
        done.append(small.groupBy("component").applyInPandas(pack, schema))
        large = component.join(sizes.where(F.col("rows") > PACK_ROWS), "component", "left_semi").select(*columns)
        pool = materialize(large, "edge-pool")
        if not pool.limit(1).count():
            break
        scored = pool.groupBy("edge").agg(F.sum("score").alias("total"), (F.count_distinct("unit") + F.max(F.col("is_split").cast("int"))).alias("n"))
        ranked = pool.join(scored, "edge")
        # Highest score, then the smaller edge: the least of (-score, edge).
        first = ranked.groupBy("unit").agg(F.min(F.struct((-F.col("total")).alias("t"), "edge")).alias("f"))
        leads = ranked.join(first, "unit").groupBy("edge", "n").agg(F.bool_and(F.col("f.edge") == F.col("edge")).alias("all")).where("all")
        leads = materialize(leads.select("edge", (F.col("n") >= cfg.edge_reads).alias("takes")), "leading-edges")
        taken = materialize(pool.join(leads.where("takes"), "edge", "left_semi").select("edge.*", "frag_id", "unit"), "taken")
        done.append(taken.drop("unit"))
        rest = pool.join(leads, "edge", "left_anti").join(taken.select("unit").distinct(), "unit", "left_anti")
        pool = materialize(rest.select(*columns), "edge-pool")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part.select(*out.columns))
    return out


def _components(pool: DataFrame) -> DataFrame:
    """``pool`` with ``component``, the smallest edge that shared units lead to."""
    label = materialize(pool.select("edge").distinct().withColumn("component", F.col("edge")), "labels")
    while True:
        on_unit = pool.select("edge", "unit").join(label, "edge").groupBy("unit").agg(F.min("component").alias("low"))
        reached = pool.select("edge", "unit").join(on_unit, "unit").groupBy("edge").agg(F.min("low").alias("low"))
        hop = label.join(reached, "edge").select("edge", "component", F.least("component", "low").alias("next"))
        jumped = hop.join(hop.select(F.col("edge").alias("e2"), F.col("next").alias("n2")), F.col("next") == F.col("e2")).select("edge", "component", F.least("next", "n2").alias("next"))
        jumped = materialize(jumped, "hops")
        moved = jumped.where("next <> component").limit(1).count()
        label = jumped.select("edge", F.col("next").alias("component"))
        if not moved:
            return pool.join(label, "edge")
