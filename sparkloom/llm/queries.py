"""The subpackage's queries and their SQL, for the registry at the repository's top."""

from __future__ import annotations

from .backtracking_bpe import op3_backtracking_bpe
from .best_two_fit import op6_best_two_fit
from .bottom_k_dedup import op10_bottom_k_dedup
from .cap_filter_dedup import op9_cap_filter_dedup
from .lanczos_whitening import op11_lanczos_whitening
from .license_scan import op1_license_scan
from .merkle_manifest import op12_merkle_manifest
from .mpeg_audio import op4_mpeg_audio
from .oracles import ORACLES
from .pu_toxicity import op8_pu_toxicity
from .quality_rules import op13_quality_rules
from .suffix_array_dedup import op5_suffix_array_dedup
from .suffix_automaton_dedup import op7_suffix_automaton_dedup
from .template_dedup import op2_template_dedup

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_template_dedup": op2_template_dedup,
    "op3_backtracking_bpe": op3_backtracking_bpe,
    "op4_mpeg_audio": op4_mpeg_audio,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_best_two_fit": op6_best_two_fit,
    "op7_suffix_automaton_dedup": op7_suffix_automaton_dedup,
    "op8_pu_toxicity": op8_pu_toxicity,
    "op9_cap_filter_dedup": op9_cap_filter_dedup,
    "op10_bottom_k_dedup": op10_bottom_k_dedup,
    "op11_lanczos_whitening": op11_lanczos_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_quality_rules": op13_quality_rules,
}

__all__ = ["ORACLES", "QUERIES"]
