"""Operator 1: exact top-k by inner product with no-random-access aggregation.

Candidates and queries are dealt into blocks, and each pair of blocks is one group. A candidate block keeps one list per
dimension, sorted by that component. For a query the lists are read in step, each from the end that the query's component
favours. What has been read of a candidate is added to its lower bound, in which unread parts count as the far end of
their list; its upper bound has them at the list's frontier. A candidate whose upper bound lies below the k-th best lower
bound is an outsider for good. A query stops reading when no one but k candidates is left, and these are resolved to their
exact scores; one whose last candidates tie reads to the end. The blocks' best k are merged by a window that keeps k rows
of a query per task.

Where vectors have many dimensions, bounds part candidates late, and most of the lists is read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.llm.scratch import shuffle_partitions

#: Candidates and queries in a block, at most about: what one task holds at once. Every candidate is sent to each block of
#: queries, so these are as large as memory allows; where few suffice, candidates are dealt more finely, down to LEAST.
CANDIDATE_BLOCK, LEAST_BLOCK = 32_768, 2_048
QUERY_BLOCK = 16_384
#: Queries that read a block's lists together, and stops on the way through the lists at which bounds are compared.
QUERY_STEP, STOPS = 64, 8


class SortedLists:
    """A block of integer vectors with one sorted list per dimension, read in step for many queries.

    Sums are exact: in floating point where no score can reach 2**53, and else in integers of any size.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")  # so that of equal scores the first has the smaller id
        self.ids, self.exact = ids[by_id], vectors[by_id]
        self.order = np.argsort(self.exact, axis=0, kind="stable")
        self.rank = np.empty(self.order.shape, np.int32)
        np.put_along_axis(self.rank, self.order, np.arange(len(ids), dtype=np.int32)[:, None], axis=0)
        self.widest = max(abs(int(self.exact.max())), abs(int(self.exact.min())))
        self.entries_read = 0

    def top_k(self, queries: np.ndarray, k: int, skips: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the positions and scores of the k best candidates whose id isn't its skip, best first."""
        reach = self.widest * max(abs(int(queries.max())), abs(int(queries.min()))) * queries.shape[1]
        kind = np.float64 if 2 * reach < 1 << 53 else object
        x, q = self.exact.astype(kind), queries.astype(kind)
        alive = self._read(x, q, k, self.ids[:, None] != skips[None, :])
        out = []
        for at in range(len(q)):
            left = np.flatnonzero(alive[:, at])
            scores = x[left] @ q[at] if len(left) else np.zeros(0)
            best = np.lexsort((left, -scores))[:k] if kind is np.float64 else np.array(sorted(range(len(left)), key=lambda i: (-scores[i], i))[:k], dtype=int)
            out.append((left[best], _as_long(scores[best])))
        return out

    def _read(self, x: np.ndarray, q: np.ndarray, k: int, alive: np.ndarray) -> np.ndarray:
        """Which of the ``alive`` candidates (candidate, query) may be among the best k once reading has stopped."""
        n, dims = x.shape
        lists = np.take_along_axis(x, self.order, axis=0)
        bottom, top = lists[0], lists[-1]
        high, low = np.maximum(q, 0).T, np.minimum(q, 0).T  # (dimension, query)
        lower = np.repeat((bottom @ high + top @ low)[None, :], n, axis=0)
        reading = np.flatnonzero(alive.sum(0) > k)
        depth = 0
        while depth < n and len(reading):
            stop = min(n, depth + max(1, n // STOPS))
            rows = np.flatnonzero(alive[:, reading].any(1))
            rank, own = self.rank[rows], x[rows]
            # What the next entries of each list tell: from its high end, and from its low end.
            new_high = np.where((rank >= n - stop) & (rank < n - depth), own - bottom, 0)
            new_low = np.where((rank >= depth) & (rank < stop), own - top, 0)
            lower[np.ix_(rows, reading)] += new_high @ high[:, reading] + new_low @ low[:, reading]
            self.entries_read += 2 * dims * (stop - depth)
            depth = stop
            unread_high, unread_low = (rank < n - depth).astype(x.dtype), (rank >= depth).astype(x.dtype)
            gain_high, gain_low = (lists[n - depth] - bottom)[:, None] * high[:, reading], (lists[depth - 1] - top)[:, None] * low[:, reading]
            least = lower[np.ix_(rows, reading)]
            most = least + unread_high @ gain_high + unread_low @ gain_low
            for at, query in enumerate(reading):
                mine = alive[rows, query]
                bar = _kth_best(least[mine, at], k)
                alive[rows, query] = mine & (most[:, at] >= bar)  # a tie may still enter
            reading = reading[alive[:, reading].sum(0) > k]
        return alive


def _kth_best(values: np.ndarray, k: int) -> float | int:
    return np.partition(values, len(values) - k)[len(values) - k] if values.dtype != object else sorted(values)[-k]


def _as_long(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; one that doesn't fit is an error."""
    if scores.dtype == object and any(not -(1 << 63) <= s < 1 << 63 for s in scores):
        raise OverflowError("a score doesn't fit in 64 bits")
    return scores.astype(np.int64)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.int64) for v in vectors])


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, v``: floor(scale * component) as integers; rows without an id, a vector or with a bad component are left out.

    A component that doesn't fit in 64 bits is an error.
    """
    x = F.col("x")
    good = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    scaled = F.transform(x, lambda c: F.lit(float(scale)) * c)
    floored = F.transform(scaled, lambda c: F.when(F.abs(c) < float(1 << 63), F.floor(c)).otherwise(F.raise_error(F.lit("a component doesn't fit in 64 bits"))))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).select("vec_id", floored.alias("v"))


def top_k_inner_product(
    candidates: DataFrame, queries: DataFrame, k: int = 10, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK, least_block: int = LEAST_BLOCK
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best candidates by integer inner product.

    Both inputs have ``vec_id long`` and ``v array<long>`` (see :func:`quantized`). A query's own row (same id) is no
    candidate; ties go to the smaller vec_id.

    * vectors of different lengths are never compared: a query meets the candidates of its own length;
    * a candidate id on several rows takes part once per distinct vector; rows that repeat a query count once per
      distinct vector, and their results are merged into one list of k per query id;
    * rows with a null id or vector take no part; empty vectors score 0 with each other;
    * a score that doesn't fit in 64 bits is an error;
    * empty inputs give an empty result, and extra columns are ignored.
    """
    # A row's block depends on its values alone, so a task that is run again deals in the same way.
    c, q = (df.select("vec_id", "v").where("vec_id IS NOT NULL AND v IS NOT NULL").distinct().withColumn("dims", F.size("v")) for df in (candidates, queries))
    total_c, total_q = candidates.count(), queries.count()
    n_q = max(1, -(-total_q // query_block))
    spread = min(-(-shuffle_partitions(candidates.sparkSession) // n_q), -(-total_c // least_block))
    n_c = max(1, spread, -(-total_c // candidate_block))
    c = c.withColumn("cb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_c)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    q = q.withColumn("qb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_q)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(left) and len(right) and len(left["v"].iloc[0]) == 0:  # no list to read: all score 0
            some = np.sort(left["vec_id"].to_numpy())[: k + 1]
            for query_id in right["vec_id"].unique():
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": some[some != query_id][:k], "score": 0}))
        elif len(left) and len(right):
            block = SortedLists(left["vec_id"].to_numpy(), _matrix(left["v"]))
            for start in range(0, len(right), QUERY_STEP):
                part = right.iloc[start : start + QUERY_STEP]
                query_ids = part["vec_id"].to_numpy()
                for query_id, (at, scores) in zip(query_ids, block.top_k(_matrix(part["v"]), k, query_ids), strict=True):
                    out.append(pd.DataFrame({"query_id": query_id, "vec_id": block.ids[at], "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    keys = ["dims", "cb", "qb"]
    found = c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 1024)
    return top_k_inner_product(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


OP1_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: CAST(q.v[i] AS HUGEINT) * CAST(c.v[i] AS HUGEINT))), 0) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
