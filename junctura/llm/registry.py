"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from junctura.llm.backoff import op3_lm_scores
from junctura.llm.bytepair import op9_byte_bpe
from junctura.llm.crosstokens import op12_cross_tokens
from junctura.llm.digests import OP5_SQL, op5_exact_dedup
from junctura.llm.langtags import op11_language
from junctura.llm.neardup import op7_near_duplicates
from junctura.llm.nra import OP1_SQL, op1_top_k
from junctura.llm.packing import op10_best_fit_packing
from junctura.llm.quality import op2_quality
from junctura.llm.tokencounts import op8_token_counts
from junctura.llm.tokenfiles import op6_token_files
from junctura.llm.toxicity import op4_toxicity
from junctura.llm.whitening import op13_whitening

QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_quality": op2_quality,
    "op3_lm_scores": op3_lm_scores,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_files": op6_token_files,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_token_counts": op8_token_counts,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_language": op11_language,
    "op12_cross_tokens": op12_cross_tokens,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op1_top_k": OP1_SQL,
    "op5_exact_dedup": OP5_SQL,
}
