"""Local alignment with affine gaps, as pandas UDFs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.config import JunctionConfig
from junctura.functions.sequences import kmers
from junctura.sources.shared import materialize

RESULT = "struct<score:int,ref_begin:int,ref_end:int,q_begin:int,q_end:int,cigar:string>"
REVERSED = bytes.maketrans(b"ACGT", b"TGCA")
_OTHER = dict(zip("ACGT", "TGCA", strict=True))
_LOW = -(1 << 28)
#: Reference letters of the pairs that are filled together, and of those whose ends are looked for, and cells of the bands that are filled.
BATCH_CELLS, END_CELLS, BAND_CELLS = 1 << 16, 1 << 17, 1 << 20
#: Matches from which on a query's end is taken to lie in a reference, and letters behind its last beginning that are looked at.
REACHED, LOOKED_AT = 24, 32
#: Seeds whose hashes are shipped to the tasks (8 bytes each), and letters that are hashed at a time.
SMALL_SEEDS, SEED_LETTERS = 4_000_000, 1 << 20


def codes(s: str) -> np.ndarray:
    """Letters as numbers; anything but A, C, G, T is 4, which matches nothing."""
    table = np.full(256, 4, np.int8)
    table[list(b"ACGT")] = range(4)
    return table[np.frombuffer(s.upper().encode("ascii", "replace"), np.uint8)]


def fill(q: np.ndarray, r: np.ndarray, cfg: JunctionConfig, local: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores by (query, reference) prefix: best, ending in a match, ending in an inserted base.

    A gap of k bases costs gap_open + (k - 1) * gap_extend. A deletion does not open straight from an insertion. Each
    row is a handful of array operations: a deletion's best opening is a running maximum along the reference.
    """
    n, m = len(q), len(r)
    best = np.zeros((n + 1, m + 1), np.int32)
    diagonal, insertion = np.full((n + 1, m + 1), _LOW, np.int32), np.full((n + 1, m + 1), _LOW, np.int32)
    steps = np.arange(m + 1, dtype=np.int32) * cfg.gap_extend
    if not local:
        best[0, 1:] = -cfg.gap_open - steps[:-1]
    for i in range(1, n + 1):
        same = (r == q[i - 1]) & (r < 4)
        diagonal[i, 1:] = best[i - 1, :-1] + np.where(same, cfg.match, -cfg.mismatch)
        insertion[i] = np.maximum(best[i - 1] - cfg.gap_open, insertion[i - 1] - cfg.gap_extend)
        start = diagonal[i] if not local else np.maximum(diagonal[i], 0)
        deletion = np.full(m + 1, _LOW, np.int32)
        deletion[1:] = np.maximum.accumulate(start[:-1] + steps[:-1]) - cfg.gap_open - steps[:-1]
        row = np.maximum(np.maximum(diagonal[i], insertion[i]), deletion)
        best[i] = np.maximum(row, 0) if local else row
    return best, diagonal, insertion


def ends(queries: np.ndarray, refs: np.ndarray, cfg: JunctionConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of rows: the best local score, and how much of the reference and of the query it takes up to there.

    All pairs are filled at once, a row of the query a step, and only the last row is kept. Of equal scores the one that ends
    leftmost on the reference counts, then earliest on the query. Rows are filled up with 4, which matches nothing.
    """
    (pairs, n), m = queries.shape, refs.shape[1]
    small = max(cfg.match * min(n, m), cfg.gap_extend * (m + 1) + cfg.gap_open) < 16_000  # two bytes a cell hold it
    kind, low = (np.int16, -16_000) if small else (np.int32, _LOW)
    steps = np.arange(m + 1, dtype=kind) * kind(cfg.gap_extend)
    opened, match, mismatch = steps[:-1] + kind(cfg.gap_open), kind(cfg.match), kind(-cfg.mismatch)
    best, insertion, deletion = np.zeros((pairs, m + 1), kind), np.full((pairs, m + 1), low, kind), np.full((pairs, m + 1), low, kind)
    top, top_row = np.zeros((pairs, m + 1), kind), np.zeros((pairs, m + 1), np.int32)
    start = np.zeros((pairs, m + 1), kind)
    queries = np.where(queries == 4, np.int8(5), queries)  # no letter of a reference
    for i in range(n):
        np.maximum(best - kind(cfg.gap_open), insertion - kind(cfg.gap_extend), out=insertion)
        np.add(best[:, :-1], np.where(refs == queries[:, i, None], match, mismatch), out=start[:, 1:])
        np.maximum(start, 0, out=start)
        np.maximum.accumulate(start[:, :-1] + steps[:-1], axis=1, out=deletion[:, 1:])
        deletion[:, 1:] -= opened
        np.maximum(start, insertion, out=best)
        np.maximum(best, deletion, out=best)
        better = best > top
        if better.any():
            np.copyto(top, best, where=better)
            np.copyto(top_row, i + 1, where=better)
    score = top.max(axis=1).astype(np.int32)
    column = np.argmax(top == score[:, None], axis=1)
    return score, column, top_row[np.arange(pairs), column]


def band_of(n: int, m: int, cfg: JunctionConfig, score: int) -> tuple[int, int]:
    """The diagonals (reference less query) that an end-to-end alignment of that score can reach.

    To leave the shortest way by e diagonals and to come back costs two gaps of e letters and e matches.
    """
    off = 0
    while cfg.match * (min(n, m) - off) - (2 * cfg.gap_open + 2 * (off - 1) * cfg.gap_extend if off else 0) >= score and off < max(n, m):
        off += 1
    return max(-n, min(0, m - n) - off), min(m, max(0, m - n) + off)


def banded(queries: list[np.ndarray], refs: list[np.ndarray], bands: list[tuple[int, int]], cfg: JunctionConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """End-to-end scores as ``fill`` has them, by (pair, query prefix, place in the band), of each pair's own band alone.

    Place c of row i is the reference's prefix of i + low + c letters; what a band doesn't hold is out of reach.
    """
    n, width = max(map(len, queries)), max(high - low + 1 for low, high in bands)
    q = _stacked(queries)
    letters, inside = np.full((len(refs), n + width + 1), 5, np.int8), np.zeros((len(refs), n + width + 1), bool)
    best, diagonal, insertion = (np.full((len(refs), n + 1, width + 1), _LOW, np.int32) for _ in range(3))
    steps = np.arange(width, dtype=np.int32) * cfg.gap_extend
    for k, (r, (low, high)) in enumerate(zip(refs, bands, strict=True)):
        first, last = max(0, -low), min(n + width, len(r) - low)  # places t with a prefix of t + low letters
        inside[k, first : last + 1] = True
        from_ = max(0, 1 - low)
        letters[k, from_ : last + 1] = r[from_ + low - 1 : last + low]
        zero = -low
        best[k, 0, zero] = 0
        best[k, 0, zero + 1 : min(high, len(r)) - low + 1] = -cfg.gap_open - steps[: max(0, min(high, len(r)))]
    for i in range(1, n + 1):
        here, r = inside[:, i : i + width], letters[:, i : i + width]
        letter = q[:, i - 1, None]
        diagonal[:, i, :width] = np.where(here & (r < 5), best[:, i - 1, :width] + np.where((r == letter) & (letter < 4), np.int32(cfg.match), np.int32(-cfg.mismatch)), _LOW)
        insertion[:, i, :width] = np.where(here, np.maximum(best[:, i - 1, 1:] - cfg.gap_open, insertion[:, i - 1, 1:] - cfg.gap_extend), _LOW)
        deletion = np.full((len(refs), width), _LOW, np.int32)
        deletion[:, 1:] = np.maximum.accumulate(diagonal[:, i, : width - 1] + steps[:-1], axis=1) - cfg.gap_open - steps[:-1]
        best[:, i, :width] = np.where(here, np.maximum(np.maximum(diagonal[:, i, :width], insertion[:, i, :width]), deletion), _LOW)
    return best, diagonal, insertion


def traces(queries: list[np.ndarray], refs: list[np.ndarray], scores: list[int], cfg: JunctionConfig) -> list[list[tuple[int, str]]]:
    """Operations, as runs, of the best end-to-end alignments of pairs whose scores are known; matches first."""
    out: list = [None] * len(queries)
    open_: dict = {}
    for k, (q, r, score) in enumerate(zip(queries, refs, scores, strict=True)):
        if len(q) == len(r):
            same = (q == r) & (q < 4)
            if cfg.match * int(same.sum()) - cfg.mismatch * int((~same).sum()) == score:
                out[k] = _runs(np.where(same, "=", "X").tolist())
                continue
        open_[k] = band_of(len(q), len(r), cfg, score)
    order = sorted(open_, key=lambda k: (len(queries[k]) // 16, open_[k][1] - open_[k][0]))
    batch: list[int] = []
    for k in [*order, None]:
        if batch and (k is None or (len(batch) + 1) * (len(queries[k]) + 16) * (open_[k][1] - open_[k][0] + 2) > BAND_CELLS or len(queries[k]) > len(queries[batch[0]]) + 16):
            tables = banded([queries[x] for x in batch], [refs[x] for x in batch], [open_[x] for x in batch], cfg)
            for x, *table in zip(batch, *tables, strict=True):
                out[x] = _walk(queries[x], refs[x], open_[x][0], cfg, *table)
            batch = []
        batch.append(k)
    return out


def _walk(q: np.ndarray, r: np.ndarray, low: int, cfg: JunctionConfig, best: np.ndarray, diagonal: np.ndarray, insertion: np.ndarray) -> list[tuple[int, str]]:
    i, j, ops, state = len(q), len(r), [], "H"
    while i or j:
        c = j - i - low
        if state == "I":
            opened = i == 1 or insertion[i, c] == best[i - 1, c + 1] - cfg.gap_open
            ops.append("I")
            i, state = i - 1, "H" if opened else "I"
        elif i and j and best[i, c] == diagonal[i, c]:
            ops.append("=" if q[i - 1] == r[j - 1] and q[i - 1] < 4 else "X")
            i, j = i - 1, j - 1
        elif i and best[i, c] == insertion[i, c]:
            state = "I"
        else:  # a deletion: the nearest opening that explains the score
            k = next((k for k in range(1, j + 1) if i == 0 and k == j or i and c - k >= 0 and diagonal[i, c - k] - cfg.gap_open - (k - 1) * cfg.gap_extend == best[i, c]), j)
            ops += ["D"] * k
            j -= k
    return _runs(ops[::-1])


def _runs(ops: list[str]) -> list[tuple[int, str]]:
    runs: list[tuple[int, str]] = []
    for op in ops:
        if runs and runs[-1][1] == op:
            runs[-1] = (runs[-1][0] + 1, op)
        else:
            runs.append((1, op))
    return runs


def _stacked(rows: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), 4, np.int8)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def align_many(pairs: list[tuple[str, str]], cfg: JunctionConfig) -> list[tuple[int, int, int, int, int, str] | None]:
    """For each pair of query and reference the score, first and last base on the reference and on the query, and CIGAR;
    None if nothing matches.

    Of equal scores the one that ends leftmost on the reference, then earliest on the query; of its beginnings the
    rightmost. Pairs of similar size are filled together, first forwards to find their ends, then backwards from there.
    """
    out: list = [None] * len(pairs)
    coded = {k: (codes(q), codes(r)) for k, (q, r) in enumerate(pairs) if q and r}
    order = sorted(coded, key=lambda k: (len(coded[k][0]) // 32, len(coded[k][1])))
    for batch in _batches(order, coded, 32, BATCH_CELLS):
        q, r = zip(*[coded[k] for k in batch], strict=True)
        score, r_end, q_end = ends(_stacked(q), _stacked(r), cfg)
        hit = [x for x in range(len(batch)) if score[x] > 0]
        if not hit:
            continue
        back = ends(_stacked([q[x][: q_end[x]][::-1] for x in hit]), _stacked([r[x][: r_end[x]][::-1] for x in hit]), cfg)
        spans = [(int(q_end[x]) - row, int(q_end[x]), int(r_end[x]) - column, int(r_end[x])) for x, column, row in zip(hit, back[1].tolist(), back[2].tolist(), strict=True)]
        runs = traces([q[x][a:b] for x, (a, b, _, _) in zip(hit, spans, strict=True)], [r[x][c:d] for x, (_, _, c, d) in zip(hit, spans, strict=True)], score[hit].tolist(), cfg)
        for x, (q_begin, q_stop, r_begin, r_stop), ops in zip(hit, spans, runs, strict=True):
            clips = [(q_begin, "S")] * (q_begin > 0), [(len(q[x]) - q_stop, "S")] * (q_stop < len(q[x]))
            out[batch[x]] = int(score[x]), r_begin, r_stop - 1, q_begin, q_stop - 1, "".join(f"{c}{op}" for c, op in (*clips[0], *ops, *clips[1]))
    return out


def _batches(order: list, coded: dict, step: int, cells: int) -> Iterator[list]:
    """Consecutive pairs whose rows together are ``cells`` at most, and whose sizes are alike."""
    batch: list = []
    for k in order:
        n, m = map(len, coded[k])
        if batch:
            n0, m0 = map(len, coded[batch[0]])
            if (len(batch) + 1) * m > cells or n > n0 + step or m > m0 + m0 // 4 + step:
                yield batch
                batch = []
        batch.append(k)
    if batch:
        yield batch


def align(query: str, ref: str, cfg: JunctionConfig) -> tuple[int, int, int, int, int, str] | None:
    """:func:`align_many` of one pair."""
    return align_many([(query, ref)], cfg)[0]


def turned(s: str) -> str:
    """The other strand, read forwards, as ``reverse_complement`` has it."""
    return "".join(_OTHER.get(c, "N") for c in reversed(s.upper()))


def spans_query(pairs: list[tuple[str, str]], share: float, cfg: JunctionConfig) -> np.ndarray:
    """Whether the best alignment of each pair of query and reference, as :func:`align_many` finds it, has its last base on the
    query at least ``share`` of the query's length behind its first.

    Only pairs whose two ends can be part of it are filled, and backwards only those that end far enough on the query; nothing
    is traced. A text that equals the other lies in it as a whole.
    """
    out = np.zeros(len(pairs), bool)
    places: dict[tuple[str, str], list[int]] = {}
    for k, (q, r) in enumerate(pairs):
        places.setdefault((q, r), []).append(k)
    held, coded, known = [], {}, {}
    for pair in places:
        q, r = pair
        if not q or not r or len(q) - 1 < share * len(q):
            continue
        for s in pair:
            if s not in known:
                known[s] = codes(s)
        if q == r and known[q].max() < 4:
            held.append(pair)
        else:
            coded[pair] = known[q], known[r]
    order = sorted(_with_both_ends(coded, share, cfg), key=lambda p: (len(coded[p][0]) // 32, len(coded[p][1])))
    for batch in _batches(order, coded, 32, BATCH_CELLS):
        q, r = zip(*[coded[p] for p in batch], strict=True)
        score, r_end, q_end = ends(_stacked(q), _stacked(r), cfg)
        far = [x for x in range(len(batch)) if score[x] > 0 and q_end[x] - 1 >= share * len(q[x])]
        if far:
            back = ends(_stacked([q[x][: q_end[x]][::-1] for x in far]), _stacked([r[x][: r_end[x]][::-1] for x in far]), cfg)
            held += [batch[x] for x, row in zip(far, back[2].tolist(), strict=True) if row - 1 >= share * len(q[x])]
    for pair in held:
        out[places[pair]] = True
    return out


def _with_both_ends(coded: dict, share: float, cfg: JunctionConfig) -> list:
    """Of pairs of query and reference those whose best alignment may take ``share`` of the query, by its ends alone.

    Such an alignment begins within the first letters of the query and ends within its last ones. As it is the best and the
    shortest of the best, each part of it that begins where it begins, or ends where it ends, scores more than 0. So from each
    end of the query a path of positive scores has to go on beyond the letters it may begin with.
    """
    if not (0 < cfg.match <= 20 and 0 <= cfg.mismatch <= 100 and 0 < cfg.gap_extend <= cfg.gap_open <= 60):
        return list(coded)  # the scores below take a byte
    left, least = [], {}
    for p, (q, _) in coded.items():
        least[p] = next(k for k in range(int(share * len(q)), len(q) + 2) if k >= share * len(q)) + 1
        left.append(p)
    short = [p for p in left if 2 * least[p] - len(coded[p][0]) - 1 < 16]  # too few letters to tell by
    left = [p for p in left if 2 * least[p] - len(coded[p][0]) - 1 >= 16]
    for step in (-1, 1):
        found = []
        for batch in _batches(sorted(left, key=lambda p: (len(coded[p][0]) // 128, len(coded[p][1]))), coded, 128, END_CELLS):
            begins = [len(coded[p][0]) - least[p] + 1 for p in batch]
            ahead = min(LOOKED_AT, min(least[p] - b for p, b in zip(batch, begins, strict=True)))
            queries, refs = zip(*[(coded[p][0][::step], coded[p][1][::step]) for p in batch], strict=True)
            found += [p for p, there in zip(batch, _begun(queries, refs, begins, ahead, cfg).tolist(), strict=True) if there]
        left = found
    return short + left


def _begun(queries: list[np.ndarray], refs: list[np.ndarray], begins: list[int], ahead: int, cfg: JunctionConfig) -> np.ndarray:
    """Of each pair whether a path that begins on one of the first ``begins`` letters of the query stays above 0 for ``ahead`` more.

    Paths of all pairs are followed a letter of the queries a step, so that the last letters to begin on meet. A deletion is
    looked for only behind cells that can pay it, which are few. Paths that get to REACHED matches are taken to go on, and
    scores are never lower than the true ones, so no pair is lost.
    """
    pairs, width, last = len(refs), max(map(len, refs)) + 1, max(begins)
    letters, text = np.full((last + ahead, pairs), 5, np.int8), np.full((pairs, width), 4, np.int8)  # 4 and 5 match nothing
    for k, (q, r, n) in enumerate(zip(queries, refs, begins, strict=True)):
        letters[last - n :, k] = np.where(q[: n + ahead] == 4, np.int8(5), q[: n + ahead])
        text[k, 1 : len(r) + 1] = r
    opened, longer, mismatch, step, enough = np.int8(cfg.gap_open), np.int8(cfg.gap_extend), np.int8(cfg.mismatch), np.int8(cfg.match + cfg.mismatch), min(REACHED * cfg.match, 100)
    best, now, insertion, gain, zero = (np.zeros((pairs, width), np.int8) for _ in range(5))
    same, reached = np.zeros((pairs, width), bool), np.zeros(pairs, bool)
    for i in range(last + ahead):
        np.equal(text, letters[i][:, None], out=same)
        np.multiply(same.view(np.int8), step, out=gain)
        np.subtract(gain, mismatch, out=gain)
        flat = now.reshape(-1)
        np.add(best.reshape(-1)[:-1], gain.reshape(-1)[1:], out=flat[1:])
        if i >= last:
            now[:, 1:] *= best[:, :-1] > 0
        np.subtract(insertion, longer, out=insertion)
        np.maximum(insertion, best - opened, out=insertion)
        np.maximum(now, insertion, out=now)
        np.maximum(now, zero, out=now)
        now[:, 0] = 0
        top = now.max(axis=1)
        if top.max() >= enough:
            rows = np.flatnonzero(top >= enough)
            reached[rows] = True
            text[rows], now[rows], insertion[rows], top[rows] = 4, 0, 0, 0
        rows = np.flatnonzero(top > opened)
        if len(rows):
            row, column = np.nonzero(now[rows] > opened)
            at = rows[row] * width + column
            left = flat[at] - opened
            many = -(-left // longer)  # lengths that can be paid
            gone = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            to = np.repeat(at, many) + gone + 1
            there = to < len(flat)
            np.maximum.at(flat, to[there], (np.repeat(left, many) - gone * longer)[there].astype(np.int8))
        best, now = now, best
        if i >= last and not best.any():
            break
    return reached | best.any(axis=1)


def sw_align(query: Column, ref: Column, cfg: JunctionConfig | None = None) -> Column:
    """The alignment of two sequences as a RESULT struct; null where nothing matches or an input is null."""
    cfg = cfg or JunctionConfig()

    @F.pandas_udf(RESULT)
    def run(queries: pd.Series, refs: pd.Series) -> pd.DataFrame:
        given = list(zip(queries, refs, strict=True))
        distinct = list(dict.fromkeys(x for x in given if x[0] and x[1]))
        found = dict(zip(distinct, align_many(distinct, cfg), strict=True))
        out = pd.DataFrame([found.get(x) or (None,) * 6 for x in given], columns=["score", "ref_begin", "ref_end", "q_begin", "q_end", "cigar"])
        return out.astype({c: "Int32" for c in out.columns[:5]})

    return run(query, ref)


def align_both_strands(df: DataFrame, query: str, ref: str, cfg: JunctionConfig | None = None) -> DataFrame:
    """``df`` with ``score, ref_begin, ref_end, q_begin, q_end, cigar, q_strand``; the other strand wins ties."""
    from junctura.functions.sequences import reverse_complement

    both = df.withColumn("__m", sw_align(reverse_complement(F.col(query)), F.col(ref), cfg)).withColumn("__p", sw_align(F.col(query), F.col(ref), cfg))
    plus = F.coalesce(F.col("__p.score"), F.lit(0)) > F.coalesce(F.col("__m.score"), F.lit(0))
    chosen = F.when(plus, F.col("__p")).otherwise(F.col("__m"))
    return both.withColumn("__c", chosen).withColumn("q_strand", F.when(plus, "+").otherwise("-")).select(*df.columns, "__c.*", "q_strand")


def dealt(pairs: DataFrame) -> DataFrame:
    """``pairs`` to align in a given number of partitions, as few bytes are much work."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sharing_seeds(reads: DataFrame, references: DataFrame, keys: list[str], ref: str, k: int, small: int = SMALL_SEEDS) -> DataFrame:
    """``keys, ref`` of reads (``keys, seq``) and references (``ref, seq``) that have a k-mer in common, each pair once.

    For references small enough to be searched without an aligner's index; alignments of large ones are an input. Hashes of up
    to ``small`` seeds are shipped, so that of reads only k-mers go on whose hash is among them; their letters decide.
    """
    seeds = materialize(references.select(ref, F.explode(kmers(F.col("seq"), k)).alias("kmer")).distinct(), "seeds")
    if seeds.limit(small + 1).count() <= small:
        at = _likely_kmers(reads, seeds, keys, k)
    else:
        at = reads.select(*keys, F.explode(F.array_distinct(kmers(F.col("seq"), k))).alias("kmer"))
    return at.join(seeds, "kmer").select(*keys, ref).distinct()


def _likely_kmers(reads: DataFrame, seeds: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``keys, kmer``: the k-mers of reads that have the hash of a seed."""
    hashed = np.unique(_rolling(_letters("".join(seeds.select("kmer").distinct().toArrow().column("kmer").to_pylist())), k)[::k])  # ``small`` at most
    shipped = reads.sparkSession.sparkContext.broadcast(hashed)
    types = {f.name: f.dataType.simpleString() for f in reads.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        table = np.zeros(1 << 22, bool)
        table[(known >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            texts = [s or "" for s in batch.column(len(keys)).to_pylist()]
            row, kmer = [], []
            for first, last in _stretches(texts):
                sizes = np.array([len(s) for s in texts[first:last]], np.int64)
                stops = np.cumsum(sizes)
                letters = _letters(whole := "".join(texts[first:last]))
                found = _rolling(letters, k)
                at = np.flatnonzero(table[(found >> np.uint64(42)).astype(np.int64)])
                spot = np.searchsorted(known, found[at])
                at = at[known[np.minimum(spot, len(known) - 1)] == found[at]] if len(known) else at[:0]
                of = np.searchsorted(stops, at, side="right")
                inside = at + k <= stops[of]
                for x, a in dict.fromkeys(zip(of[inside].tolist(), (whole[a : a + k] for a in at[inside].tolist()), strict=True)):
                    row.append(first + x)
                    kmer.append(a)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]), pa.array(kmer, pa.string())], names=[*keys, "kmer"])

    return reads.select(*keys, "seq").mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in keys), "kmer string"]))


def _stretches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of some SEED_LETTERS together."""
    first, size = 0, 0
    for k, s in enumerate(texts):
        size += len(s)
        if size >= SEED_LETTERS or k + 1 == len(texts):
            yield first, k + 1
            first, size = k + 1, 0


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _rolling(letters: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k letters from each place on: hashes of stretches twice as long from those of shorter ones."""
    if len(letters) < k:
        return np.zeros(0, np.uint64)
    total, done, part, size, base = np.zeros(len(letters) - k + 1, np.uint64), 0, letters + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while done < k:
        if k & size:
            total = total * np.uint64(pow(base, size, 1 << 64)) + part[done : done + len(total)]
            done += size
        part = part[:-size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
        size *= 2
    x = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def align_segments(members: DataFrame, regions: DataFrame, segments: DataFrame, cfg: JunctionConfig | None = None) -> DataFrame:
    """``region_id, frag_id, is_virus`` and the alignment of each fragment's segment to each of its regions.

    ``members``: ``region_id, frag_id``; ``regions``: ``region_id, is_virus, seq``; ``segments``: ``frag_id, is_virus, seq`` as
    they were read. Kept are alignments that are acceptable and near the fragment's best on the organism; as the joins
    spread a fragment's regions, that best is found by a window over fragments.
    """
    cfg = cfg or JunctionConfig()
    at = members.join(regions.select("region_id", "is_virus", F.col("seq").alias("ref")), "region_id")
    both = at.join(segments.select("frag_id", "is_virus", F.col("seq").alias("query")), ["frag_id", "is_virus"])
    found = accepted(align_both_strands(dealt(both), "query", "ref", cfg), cfg).drop("ref", "query")
    return relative(found, ["frag_id", "is_virus"], cfg)


def on_both_sides(edge_reads: DataFrame, alignments: DataFrame, facts: list[str]) -> DataFrame:
    """``edge_reads`` (``h_region, v_region, frag_id, ...``) with ``h_`` and ``v_`` facts of both alignments; reads that lack
    either are left out."""
    out = edge_reads
    for side, region in (("h", "h_region"), ("v", "v_region")):
        mine = alignments.select(F.col("region_id").alias(region), "frag_id", *[F.col(c).alias(f"{side}_{c}") for c in facts])
        out = out.join(mine, [region, "frag_id"])
    return out


def reads_on_both_organisms(alignments: DataFrame, read: str = "read_id") -> DataFrame:
    """Alignments of reads that have some on the host and some on the virus."""
    both = alignments.groupBy(read).agg(F.count_distinct("is_virus").alias("n")).where("n = 2").select(read)
    return alignments.join(both, read, "left_semi")


def accepted(df: DataFrame, cfg: JunctionConfig) -> DataFrame:
    """Alignments long and good enough that are not clipped at both ends."""
    both_clipped = F.col("cigar").rlike(r"^\d+S.*\d+S$")
    return df.where((F.col("ref_end") - F.col("ref_begin") + 1 >= cfg.min_aligned) & (F.col("score") >= cfg.min_score) & ~both_clipped)


def relative(df: DataFrame, by: list[str], cfg: JunctionConfig) -> DataFrame:
    """Alignments that score at least a share of the best of their group."""
    from pyspark.sql import Window

    top = F.max("score").over(Window.partitionBy(*by))
    return df.withColumn("__top", top).where(F.col("score") >= cfg.relative_score * F.col("__top")).drop("__top")
