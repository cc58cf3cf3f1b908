"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import op8_decontamination
from .fingerprints import op2_fingerprints
from .html_extraction import op9_html_extraction
from .lm_scoring import op4_lm_scoring
from .packing import op7_packing
from .simhash import op6_simhash_dedup
from .substring_dedup import op10_substring_dedup
from .token_files import op1_token_files
from .toxicity import op5_toxicity
from .url_filters import OP3_SQL, op3_url_filters

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_fingerprints": op2_fingerprints,
    "op3_url_filters": op3_url_filters,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_toxicity": op5_toxicity,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_html_extraction": op9_html_extraction,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLE_SQL = {"op3_url_filters": OP3_SQL}
