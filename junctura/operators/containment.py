"""Edges that lie within other edges, found without making the pairs of a dense place."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.sources.shared import materialize

KEYS = ["h_chr", "h_strand", "v_chr", "v_strand"]
SPANS = ["h_left", "h_right", "v_left", "v_right"]
TO = [f"to_{c}" for c in SPANS]
CELL = [*KEYS, "__level", "__h", "__v"]
#: Cells of up to so many outer edges are joined, denser ones are searched by tasks; rows of one such task, of either side.
DENSE, SLICE = 64, 200_000
_FAN = 8


def containers(edges: DataFrame, dense: int = DENSE, slice_rows: int = SLICE) -> DataFrame:
    """Each edge with the edge that swallows it: ``h_*, v_*`` and ``to_h_left, to_h_right, to_v_left, to_v_right``.

    An edge contains another if contigs and strands are the same and both its spans contain the other's. The container that
    nothing else contains is chosen, of several the one with the smallest place; an edge that nothing contains maps to
    itself. Repeated edges count once, and edges with a null take no part. ``dense`` and ``slice_rows`` don't change the result.

    First every edge is searched for one that properly contains it, which leaves the edges that nothing contains; then each
    edge is searched for the first of these.
    """
    placed = materialize(edges.select(*KEYS, *SPANS).na.drop().distinct().withColumn("__level", _size_class()), "placed-edges")
    levels = [r[0] for r in placed.select("__level").distinct().collect()]  # at most 32
    swallowed = within(placed, placed, levels, True, dense, slice_rows).select(*KEYS, *SPANS)
    top = materialize(placed.join(swallowed, [*KEYS, *SPANS], "left_anti"), "top-edges")
    return within(placed, top, levels, False, dense, slice_rows)


def _size_class() -> Column:
    """Edges of class k have spans below 1024 * 4^k, so that they touch at most two bins of that width by organism."""
    longest = F.greatest(F.col("h_right") - F.col("h_left"), F.col("v_right") - F.col("v_left"), F.lit(0)).cast("long")
    return F.floor((F.length(F.bin(F.shiftright(longest, 10))) + 1) / 2).cast("int")


def within(inner: DataFrame, outer: DataFrame, levels: list[int], proper: bool, dense: int, slice_rows: int) -> DataFrame:
    """Each inner edge that some outer edge contains, with the one of the smallest place; ``proper``: not by itself.

    An outer edge enters the two by two bins of its size class that it touches; an inner edge is looked for in the bin of
    its first bases, in its own and all greater classes. Cells of few outer edges are joined. Where a cell holds many, its
    inner rows are dealt into shards and its outer rows into slices, and a task searches one slice for one shard.
    """
    width = F.expr("shiftleft(1024L, 2 * __level)")

    def bins(name: str) -> Column:
        start = F.floor(F.col(f"{name}_left") / width)
        return F.sequence(start, F.greatest(start, F.floor(F.col(f"{name}_right") / width)))

    upward = F.filter(F.array(*[F.lit(k) for k in sorted(levels)] or [F.lit(0)]), lambda k: k >= F.col("__level"))
    looking = inner.withColumn("__level", F.explode(upward)).withColumns({"__h": F.floor(F.col("h_left") / width), "__v": F.floor(F.col("v_left") / width)})
    held = outer.withColumn("__h", F.explode(bins("h"))).withColumn("__v", F.explode(bins("v")))
    held_rows, looking_rows = (df.groupBy(*CELL).agg(F.count("*").alias(n)) for df, n in ((held, "__held"), (looking, "__looking")))
    sizes = materialize(held_rows.join(looking_rows, CELL), "cell-sizes")

    few = held.join(sizes.where(F.col("__held") <= dense).select(*CELL), CELL).select(*CELL, *[F.col(c).alias(f"to_{c}") for c in SPANS])
    holds = "to_h_left <= h_left AND h_right <= to_h_right AND to_v_left <= v_left AND v_right <= to_v_right"
    differs = "(to_h_left <> h_left OR to_h_right <> h_right OR to_v_left <> v_left OR to_v_right <> v_right)"
    joined = looking.join(few, CELL).where(f"{holds} AND {differs}" if proper else holds).select(*KEYS, *SPANS, *TO)

    parts = {n: F.ceil(F.col(f"__{n}") / slice_rows) for n in ("held", "looking")}
    many = sizes.where(F.col("__held") > dense).select(*CELL, parts["held"].alias("__slices"), parts["looking"].alias("__shards"))
    deal = {n: F.pmod(F.xxhash64(*SPANS), F.col(n)) for n in ("__slices", "__shards")}
    copies = {n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)) for n in ("__slices", "__shards")}
    task = [*CELL, "__shard", "__slice"]
    left = looking.join(many, CELL).withColumn("__shard", deal["__shards"]).withColumn("__slice", copies["__slices"])
    right = held.join(many, CELL).withColumn("__slice", deal["__slices"]).withColumn("__shard", copies["__shards"])
    right = right.select(*[F.col(c).alias(f"o_{c}") for c in [*task, *SPANS]])
    rows = [f"{f.name} {f.dataType.simpleString()}" for f in inner.select(*KEYS, *SPANS).schema]
    kinds = {c: inner.schema[c].dataType.simpleString() for c in SPANS}

    def search(asked: pd.DataFrame, slice_: pd.DataFrame) -> pd.DataFrame:
        at, found = first_containers(asked[SPANS].to_numpy(np.int64), slice_[[f"o_{c}" for c in SPANS]].to_numpy(np.int64), proper)
        out = asked.iloc[at][[*KEYS, *SPANS]].reset_index(drop=True)
        return out.assign(**{name: found[:, k] for k, name in enumerate(TO)})

    schema = ", ".join([*rows, *[f"to_{c} {kinds[c]}" for c in SPANS]])
    searched = left.groupBy(*task).cogroup(right.groupBy(*[f"o_{c}" for c in task])).applyInPandas(search, schema)
    first = joined.unionByName(searched).groupBy(*KEYS, *SPANS).agg(F.min(F.struct(*TO)).alias("__to"))
    return first.select(*KEYS, *SPANS, "__to.*")


def first_containers(inner: np.ndarray, outer: np.ndarray, proper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of inner rows (left, right, left, right) that an outer row contains, and of each the first such row.

    With the right ends negated, a row contains another if it is not above it in any column. The outer rows, in the order of
    place, are the leaves of a tree whose nodes carry the least of each column, so a node that is above a row in some
    column is skipped with all its leaves. All rows walk the tree at once, each from left to right to its first leaf.
    Where any container will do (``proper``), the leaves are in the order of interleaved bits instead, which parts all columns.
    """
    if not len(inner) or not len(outer):
        return np.zeros(0, np.int64), np.zeros((0, 4), np.int64)
    sign = np.array([1, -1, 1, -1])
    outer = outer[np.argsort(_interleaved(outer * sign))] if proper else outer[np.lexsort(outer.T[::-1])]
    trees = [outer * sign]
    while len(trees[-1]) > 1:
        last = trees[-1]
        short = -len(last) % _FAN
        full = np.concatenate([last, np.full((short, 4), np.iinfo(np.int64).max)])
        trees[-1] = full
        trees.append(full.reshape(-1, _FAN, 4).min(axis=1))
    first = np.cumsum([0, *[len(t) for t in trees]])
    nodes, root = np.concatenate(trees), len(trees) - 1
    asked = inner * sign
    row, level, place = np.arange(len(inner)), np.full(len(inner), root), np.zeros(len(inner), np.int64)
    hits, leaves = [], []
    while len(row):
        node = nodes[first[level] + place]
        want = asked[row]
        fits = (node <= want).all(axis=1)
        if proper:
            fits &= (level > 0) | (node != want).any(axis=1)
        hit = fits & (level == 0)
        hits.append(row[hit])
        leaves.append(place[hit])
        down = fits & ~hit
        level, place = level - down, np.where(down, place * _FAN, place + 1)
        up = ~fits & (place % _FAN == 0) & (level < root)
        while up.any():
            place, level = np.where(up, place // _FAN, place), level + up
            up &= (place % _FAN == 0) & (level < root)
        go = ~hit & ~((level == root) & (place > 0))
        row, level, place = row[go], level[go], place[go]
    at, found = np.concatenate(hits), outer[np.concatenate(leaves)]
    return at, found


def _interleaved(rows: np.ndarray, bits: int = 15) -> np.ndarray:
    """The leading bits of each row's four numbers, in turns."""
    rows = rows - rows.min(axis=0)
    rows >>= np.maximum(0, np.ceil(np.log2(rows.max(axis=0) + 1.0)).astype(np.int64) - bits)
    out = np.zeros(len(rows), np.int64)
    for bit in range(bits):
        for k in range(4):
            out |= ((rows[:, k] >> bit) & 1) << (4 * bit + k)
    return out
