"""Masking of low-complexity stretches by triplet scores in windows (symmetric DUST)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Bases in a window, and the score by triplet above which a stretch is masked.
WINDOW, THRESHOLD = 64, 2.0


def dust_spans_of(seqs: list[str], window: int = WINDOW, threshold: float = THRESHOLD) -> list[list[tuple[int, int]]]:
    """For each sequence the half-open spans under a perfect interval: one that scores above the threshold and no less
    than any part of it. The score of an interval is the number of pairs of equal triplets in it by its triplets less one.

    All sequences are laid end to end. Counting pairs in small numbers tells which places an interval above the threshold begins
    at; only stretches of a window from these on are searched, as no other interval can mask anything or outdo one that does.
    """
    gap = "\0" * 3
    letters = np.frombuffer(gap.join(s.upper() for s in seqs).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    sizes = np.array([len(s.upper()) for s in seqs], np.int64)
    starts = np.cumsum(sizes + 3) - sizes - 3
    out: list[list[tuple[int, int]]] = [[] for _ in seqs]
    if len(letters) < 3:
        return out
    hot = np.flatnonzero(_begins(letters, starts, starts + sizes, window, threshold))
    if not len(hot):
        return out
    of = np.searchsorted(starts, hot, side="right") - 1
    firsts, lasts = _runs(hot, np.minimum(hot + window, (starts + sizes)[of]), len(letters))
    wide = lasts - firsts
    at = np.cumsum(wide + 3) - wide - 3
    cut = np.zeros(int((wide + 3).sum()) - 3, np.int64)
    inner = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
    cut[np.repeat(at, wide) + inner] = letters[np.repeat(firsts, wide) + inner]
    begins, ends = _masked(cut, at, at + wide, window, threshold)
    back = (firsts - at)[np.searchsorted(at, begins, side="right") - 1]
    for x, y, k in zip((begins + back).tolist(), (ends + back).tolist(), (np.searchsorted(starts, begins + back, side="right") - 1).tolist(), strict=True):
        out[k].append((x - int(starts[k]), y - int(starts[k])))
    return out


def _begins(letters: np.ndarray, starts: np.ndarray, stops: np.ndarray, window: int, threshold: float) -> np.ndarray:
    """Whether an interval that scores above the threshold begins at a place."""
    known = np.zeros(int(letters.max()) + 1, np.int64)
    known[letters] = 1
    kinds = int(known.sum())
    code = (np.cumsum(known) - 1).astype(np.min_scalar_type(kinds**3))[letters]
    triplets = (code[:-2] * kinds + code[1:-1]) * kinds + code[2:]
    n, d_max = len(triplets), min(window - 2, len(triplets))
    least = np.min_scalar_type(window)
    room = np.minimum(_room(n, starts, stops) + 1, window).clip(0).astype(least)  # triplets of the sequence from a place on
    equal, pairs, hot = np.zeros(n, least), np.zeros(n, np.min_scalar_type(window * window)), np.zeros(n, bool)
    for d in range(1, d_max):
        m = n - d
        equal[:m] += triplets[:m] == triplets[d:]
        pairs[:m] = pairs[1 : m + 1] + equal[:m]
        hot[:m] |= (pairs[:m] > int(np.floor((threshold - 1e-9) * d))) & (room[:m] > d)
    return hot


def _room(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Triplets that may follow each of n places within its sequence; negative between sequences."""
    return np.repeat(stops, stops - starts + 3)[:n] - 3 - np.arange(n)


def _runs(begins: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of what spans cover."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, begins, 1)
    np.add.at(edges, ends, -1)
    covered = np.diff(np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]]))
    return np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)


def _masked(letters: np.ndarray, starts: np.ndarray, stops: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of masked spans. Intervals of one length are scored together, the shortest first: those that begin at a
    place and end one triplet further have one more row of pairs than those that begin one place later."""
    n = len(letters) - 2
    triplets = (letters[:-2] << 42) | (letters[1:-1] << 21) | letters[2:]  # code points have 21 bits
    room = _room(n, starts, stops)
    equal, pairs, best = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)
    reach = np.zeros(n, np.int64)  # of the longest perfect interval from a place on
    for d in range(1, min(window - 2, n)):
        m = n - d
        equal[:m] += triplets[:m] == triplets[d:]
        pairs[:m] = pairs[1 : m + 1] + equal[:m]
        inner = np.maximum(best[:m], best[1 : m + 1])
        score = pairs[:m] / d
        best[:m] = np.maximum(inner, score)
        reach[:m][(score > threshold) & (score >= inner) & (room[:m] >= d)] = d + 3
    begins = np.flatnonzero(reach)
    return _runs(begins, begins + reach[begins], len(letters))


def dust_spans(seq: str, window: int = WINDOW, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """The same for one sequence."""
    return dust_spans_of([seq], window, threshold)[0]


def dust_mask(seqs: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """``keys, start, end``: masked spans of each sequence; sequences without any have no row, null counts as empty."""
    types = {f.name: f.dataType.simpleString() for f in seqs.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in (batch.iloc[k : k + 1000] for k in range(0, len(batch), 1000)):
                found = dust_spans_of([s or "" for s in part[seq]])
                rows = [(*row, a, b) for row, spans in zip(part[keys].itertuples(index=False, name=None), found, strict=True) for a, b in spans]
                yield pd.DataFrame(rows, columns=[*keys, "start", "end"])

    return seqs.select(*keys, seq).mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "start long", "end long"]))
