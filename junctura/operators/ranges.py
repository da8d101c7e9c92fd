"""Joins and arithmetic on positions and intervals.

An inequality alone would be planned as a nested loop, so positions are put into bins and joined on the bin first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.sources.shared import materialize


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, reach: int) -> DataFrame:
    """All pairs with equal ``keys`` whose positions differ by at most ``reach``.

    Column names must differ between the sides but for ``keys``. The right side sits in one bin each and the left side
    in at most three, so no pair is found twice. Rows with a null position meet nothing.
    """
    width = max(1, reach)

    def bin_of(c: Column) -> Column:
        return F.floor(c / F.lit(width)).cast("long")

    probe = left.withColumn("__bin", F.explode(F.sequence(bin_of(F.col(left_pos) - reach), bin_of(F.col(left_pos) + reach))))
    build = right.withColumn("__bin", bin_of(F.col(right_pos)))
    near = F.abs(F.col(left_pos) - F.col(right_pos)) <= reach
    return probe.join(build, [*keys, "__bin"]).where(near).drop("__bin")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = 1024) -> DataFrame:
    """All pairs with equal ``keys`` whose half-open spans overlap.

    Both sides enter every bin that they touch; a pair is kept in the bin where its overlap begins. Empty spans meet nothing.
    """
    (ls, le), (rs, re_) = left_span, right_span

    def spread(df: DataFrame, s: str, e: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))
        return df.where(F.col(s) < F.col(e)).withColumn("__bin", F.explode(bins))

    joined = spread(left, ls, le).join(spread(right, rs, re_), [*keys, "__bin"])
    begins = F.greatest(F.col(ls), F.col(rs))
    return joined.where((F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)) & (F.col("__bin") == F.floor(begins / width))).drop("__bin")


def islands(df: DataFrame, keys: list[str], start: str, end: str, name: str = "island", more: tuple[str, ...] = (), touching: bool = True, width: int = 1 << 14) -> DataFrame:
    """Numbers the groups of half-open spans that overlap (or touch), within ``keys``, in the order of start, end, ``more``.

    Spans are cut into bins by their start, and a task sorts one bin; what reaches into a bin from those before it, and
    how many groups these open, are running totals over one row a bin. So the spans of a contig are never in one task.
    """
    binned = materialize(df.withColumn("__bin", F.floor(F.col(start) / width)), "binned-spans")
    whole = Window.partitionBy(*keys).orderBy("__bin")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    tops = binned.groupBy(*keys, "__bin").agg(F.max(end).alias("__top")).select(*keys, "__bin", F.max("__top").over(before).alias("__from"))
    order = Window.partitionBy(*keys, "__bin").orderBy(start, end, *more)
    reach = F.greatest(F.col("__from"), F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    beyond = F.col(start) > reach if touching else F.col(start) >= reach
    opens = F.when(reach.isNull() | beyond, 1).otherwise(0)
    # A bin is small beside the task that holds it, so its rows are sorted once and written with their marks.
    marked = materialize(_with_nulls(binned, tops, [*keys, "__bin"]).withColumn("__opens", opens).withColumn("__n", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__from"), "marked-spans")
    opened = marked.groupBy(*keys, "__bin").agg(F.sum("__opens").alias("__o")).select(*keys, "__bin", F.coalesce(F.sum("__o").over(before), F.lit(0)).alias("__past"))
    return _with_nulls(marked, opened, [*keys, "__bin"]).withColumn(name, F.col("__past") + F.col("__n")).select(*df.columns, name)


def _with_nulls(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys are equal."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, same).drop(*[f"__r_{k}" for k in keys])


def merged(df: DataFrame, keys: list[str], start: str, end: str, width: int = 1 << 14) -> DataFrame:
    """The union of the spans of each key, as disjoint spans: the islands' first and last places."""
    numbered = islands(df.select(*keys, start, end), keys, start, end, "__run", width=width)
    return numbered.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")


def exclude(df: DataFrame, excluded: DataFrame, key: str = "chr", start: str = "start", end: str = "end", trim: bool = False) -> DataFrame:
    """``df`` without what overlaps ``excluded`` (columns ``chr, ex_start, ex_end``).

    trim: cuts the overlap away and keeps the rest, in several rows where it falls apart; otherwise the row goes.
    """
    holes = merged(excluded.select(F.col("chr").alias(key), "ex_start", "ex_end").where("ex_start < ex_end"), [key], "ex_start", "ex_end")
    columns = df.columns
    spans = df.select(key, start, end).distinct()
    hit = overlap_join(spans, holes, [key], (start, end), ("ex_start", "ex_end"))
    if not trim:
        return df.join(hit.select(key, start, end).distinct(), [key, start, end], "left_anti").select(*columns)
    cut = hit.groupBy(key, start, end).agg(F.sort_array(F.collect_list(F.struct("ex_start", "ex_end"))).alias("__cut"))
    froms = F.concat(F.array(F.col(start)), F.transform("__cut", lambda c: c["ex_end"]))
    tos = F.concat(F.transform("__cut", lambda c: c["ex_start"]), F.array(F.col(end)))
    gaps = F.filter(F.arrays_zip(froms.alias("s"), tos.alias("e")), lambda g: g["s"] < g["e"])
    both = df.join(cut, [key, start, end], "left")
    whole = F.array(F.struct(F.col(start).alias("s"), F.col(end).alias("e")))
    parts = both.withColumn("__part", F.explode(F.when(F.col("__cut").isNull(), whole).otherwise(gaps)))
    return parts.withColumn(start, F.col("__part.s")).withColumn(end, F.col("__part.e")).select(*columns)


def covered_share(windows: DataFrame, spans: DataFrame, key: str = "chr") -> DataFrame:
    """``id, covered, share``: how much of each window (``id, chr, w_start, w_end``) the spans (``chr, s, e``) cover.

    Spans are merged before they are joined, so depth does not multiply rows; a window that nothing covers has 0.
    """
    joined = overlap_join(windows, merged(spans.select(key, "s", "e").where("s < e"), [key], "s", "e"), [key], ("w_start", "w_end"), ("s", "e"))
    part = F.least("e", "w_end") - F.greatest("s", "w_start")
    sums = joined.groupBy("id").agg(F.sum(part).alias("covered"))
    out = windows.join(sums, "id", "left")
    covered = F.coalesce("covered", F.lit(0))
    return out.select("id", covered.alias("covered"), F.when(F.col("w_end") > F.col("w_start"), covered / (F.col("w_end") - F.col("w_start"))).otherwise(0.0).alias("share"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
