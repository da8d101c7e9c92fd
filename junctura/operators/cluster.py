"""Density clustering of candidates into regions, and the alternating filter of regions and fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from junctura.operators.ranges import range_join
from junctura.sources.shared import materialize


def label_tiers(labels: DataFrame, keys: tuple[str, ...] = ("chr", "strand")) -> DataFrame:
    """``labels`` (``keys, n, ...``) with ``tier``: 1 for the most frequent count of a key, and so on without gaps.

    Counts are ranked once each, so the window sees the different counts of a contig and not its labels.
    """
    counts = labels.select(*keys, "n").distinct()
    ranked = counts.withColumn("tier", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"))))
    return labels.join(ranked, [*keys, "n"])


def assign_labels(labels: DataFrame, reach: int, keys: tuple[str, ...] = ("chr", "strand")) -> DataFrame:
    """``keys, pos, label_pos``: each label's densest label in range, itself included; all of equally dense ones.

    ``labels``: ``keys, pos, n``. A range column ``reach`` on the labels themselves, if there is one, must hold mutually.
    """
    own = "reach" in labels.columns
    extra = ["reach"] if own else []
    left = labels.select(*keys, "pos", *extra)
    right = labels.select(*keys, F.col("pos").alias("label_pos"), F.col("n").alias("label_n"), *[F.col("reach").alias("label_reach")] * own)
    near = range_join(left, right, list(keys), "pos", "label_pos", reach)
    if own:
        near = near.where(F.abs(F.col("pos") - F.col("label_pos")) <= F.least("reach", "label_reach"))
    best = F.max("label_n").over(Window.partitionBy(*keys, "pos"))
    return near.withColumn("__best", best).where("label_n = __best").select(*keys, "pos", "label_pos")


def region_bounds(candidates: DataFrame, assigned: DataFrame, keys: tuple[str, ...] = ("chr", "strand")) -> DataFrame:
    """``keys, label_pos, left, right, n_frags``: the span of a region's candidates with its label, and its fragments."""
    members = candidates.join(assigned, [*keys, "pos"])
    grouped = members.groupBy(*keys, "label_pos").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count_distinct("frag_id").alias("n_frags"))
    return grouped.select(*keys, "label_pos", F.least("lo", "label_pos").alias("left"), F.greatest("hi", "label_pos").alias("right"), "n_frags")


def region_members(candidates: DataFrame, assigned: DataFrame, keys: tuple[str, ...] = ("chr", "strand")) -> DataFrame:
    """Distinct ``keys, label_pos, is_virus, frag_id`` (and ``is_split`` where candidates have it, true if any is)."""
    members = candidates.join(assigned, [*keys, "pos"])
    split = F.bool_or("is_split") if "is_split" in candidates.columns else F.lit(False)
    return members.groupBy(*keys, "label_pos", "is_virus", "frag_id").agg(split.alias("is_split"))


def filter_fixpoint(members: DataFrame, region: list[str], support: int = 4, max_rounds: int | None = None) -> DataFrame:
    """Drops weak regions and fragments that lost a side, in turn.

    A round drops the regions with fewer than ``support`` fragments (a split one counting once more); if it dropped any,
    it drops the fragments that are no longer on both a host and a virus region; rounds end when one drops no fragment.
    A round without weak regions ends without looking at fragments. Every round's members are a written table, so plans
    don't grow and a lost executor loses no round. If ``max_rounds`` is given and they don't suffice, that is an error.
    """
    current = materialize(members, "members")
    count = current.count()
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        strong = current.groupBy(*region).agg((F.count_distinct("frag_id") + F.max(F.col("is_split").cast("int"))).alias("n")).where(F.col("n") >= support)
        kept = current.join(strong.select(*region), region, "left_semi")
        kept = materialize(kept, "strong")
        left = kept.count()
        if left == count:
            return kept
        sides = kept.groupBy("frag_id").agg(F.count_distinct("is_virus").alias("sides")).where("sides = 2")
        current = kept.join(sides.select("frag_id"), "frag_id", "left_semi").select(*kept.columns)
        current = materialize(current, "members")
        count = current.count()
        if count == left:
            return current
    raise RuntimeError(f"regions and fragments have not settled after {max_rounds} rounds")
