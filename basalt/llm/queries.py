"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from basalt.llm.exact_substrings import op6_suffix_dedup
from basalt.llm.fingerprints import op5_scaled_fingerprints
from basalt.llm.lm_scoring import op1_attention_lm
from basalt.llm.mixing import op7_cube_mixing
from basalt.llm.near_dedup import op2_dart_minhash
from basalt.llm.packing import op9_grouped_packing
from basalt.llm.quality import op8_quality_ftrl
from basalt.llm.rules import op3_isolation_rules
from basalt.llm.token_counts import op10_trie_token_counts
from basalt.llm.toxicity import op4_toxicity_nnpu

QUERIES = {
    "op1_attention_lm": op1_attention_lm,
    "op2_dart_minhash": op2_dart_minhash,
    "op3_isolation_rules": op3_isolation_rules,
    "op4_toxicity_nnpu": op4_toxicity_nnpu,
    "op5_scaled_fingerprints": op5_scaled_fingerprints,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_cube_mixing": op7_cube_mixing,
    "op8_quality_ftrl": op8_quality_ftrl,
    "op9_grouped_packing": op9_grouped_packing,
    "op10_trie_token_counts": op10_trie_token_counts,
}
ORACLES: dict[str, str] = {}
