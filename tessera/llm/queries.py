"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, license_scan, quality_rules, url_filter
from .decontaminate import op7_benchmark_decontamination
from .html_text import op1_html_extraction
from .license_scan import op5_license_scan
from .near_dedup import op2_minhash_near_dedup
from .packing import op4_packing
from .quality_model import op6_quality_classifier
from .quality_rules import op9_quality_rules
from .secret_scan import op10_secret_scans
from .spelling import op12_spelling_variants
from .suffix_tree import op8_lm_scoring
from .token_alignment import op11_token_alignment
from .token_files import op13_token_files
from .url_filter import op3_url_filters

QUERIES = {f.__name__: f for f in (
    op1_html_extraction, op2_minhash_near_dedup, op3_url_filters, op4_packing, op5_license_scan, op6_quality_classifier, op7_benchmark_decontamination, op8_lm_scoring, op9_quality_rules, op10_secret_scans,
    op11_token_alignment, op12_spelling_variants, op13_token_files)}

ORACLE_SQL = {
    "op3_url_filters": url_filter.SQL,
    "op5_license_scan": license_scan.SQL,
    "op7_benchmark_decontamination": decontaminate.SQL,
    "op9_quality_rules": quality_rules.SQL,
}
