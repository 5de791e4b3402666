"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline

from .decontaminate import op2_decontamination
from .language import op10_language_id
from .maxent import op9_lm_scoring
from .minhash import op1_minhash_dedup
from .quality import op6_quality_rules
from .shards import op4_compaction
from .sql import ORACLE
from .substring import op7_substring_dedup
from .tokens import op3_token_ids, op5_packing
from .toxicity import op8_toxicity

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_token_ids": op3_token_ids,
    "op4_compaction": op4_compaction,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_language_id": op10_language_id,
    "pipeline": corpus_pipeline.run,
}
