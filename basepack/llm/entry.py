"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import jaccard, quality, substring_dedup, suffix_dedup
from .decontam import op7_smith_waterman_decontamination
from .hmm import op9_hmm_language_model
from .jaccard import op3_ngram_jaccard_join
from .langid import op10_rank_order_language_id
from .packing import op5_harmonic_packing
from .quality import op6_quality_rule_ledger
from .sharding import op8_jump_hash_sharding
from .substring_dedup import op1_fm_index_substring_dedup
from .suffix_dedup import op2_suffix_array_dedup
from .url_filter import op4_url_logistic_filter


def queries() -> dict:
    found = [
        op1_fm_index_substring_dedup,
        op2_suffix_array_dedup,
        op3_ngram_jaccard_join,
        op4_url_logistic_filter,
        op5_harmonic_packing,
        op6_quality_rule_ledger,
        op7_smith_waterman_decontamination,
        op8_jump_hash_sharding,
        op9_hmm_language_model,
        op10_rank_order_language_id,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_fm_index_substring_dedup": substring_dedup.SQL,
        "op2_suffix_array_dedup": suffix_dedup.SQL,
        "op3_ngram_jaccard_join": jaccard.SQL,
        "op6_quality_rule_ledger": quality.SQL,
    }
