"""Parameters of a run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class JunctionConfig:
    """Defaults of every stage; distances in bases, positions 0-based and half-open throughout."""

    seed_length: int = 18
    seed_block: int = 3
    min_seed_hits: int = 2
    max_seed_base: int = 13
    min_clip_length: int = 5
    min_clip_size: int = 20
    max_alternatives: int = 6
    max_clip_distance: int = 10
    max_insert_bound: int = 1000
    homopolymer_share: float = 0.8
    dinucleotide_share: float = 0.75
    discordant_span: int = 100_000
    region_support: int = 4
    edge_support: int = 3
    edge_reads: float = 4.0
    min_aligned: int = 30
    min_score: int = 30
    relative_score: float = 0.75
    diff_rate: float = 0.06
    min_pairs: int = 4
    min_host_pbs: float = 0.8
    min_coverage: float = 0.5
    max_masked: float = 0.8
    pair_band: tuple[int, int] = (-50, 1000)
    duplicate_span: float = 0.8
    match: int = 1
    mismatch: int = 4
    gap_open: int = 6
    gap_extend: int = 1
    read_len: int = 150
    max_is: int = 500
    exploratory: bool = False
