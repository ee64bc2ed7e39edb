"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import op12_decontamination
from .hard_negatives import op13_hard_negatives
from .line_dedup import op6_line_dedup
from .lm_scoring import op3_lm_scoring
from .mixing import op5_mixing
from .oracles import ORACLES
from .packing import op8_packing
from .pii import op7_pii
from .quality_rules import op10_quality_rules
from .secret_scan import op4_secret_scan
from .simhash import op9_simhash
from .spelling import op11_spelling
from .token_files import op2_token_files
from .vectors import op1_vectors

QUERIES = {
    "op1_vectors": op1_vectors,
    "op2_token_files": op2_token_files,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_secret_scan": op4_secret_scan,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_pii": op7_pii,
    "op8_packing": op8_packing,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling": op11_spelling,
    "op12_decontamination": op12_decontamination,
    "op13_hard_negatives": op13_hard_negatives,
}

__all__ = ["ORACLES", "QUERIES"]
