"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tracelake.llm.decontamination import op5_decontamination
from tracelake.llm.html_extraction import op10_html_extraction
from tracelake.llm.importance_resampling import op13_importance_resampling
from tracelake.llm.language_id import op8_language_id
from tracelake.llm.license_scan import op1_license_scan
from tracelake.llm.license_scan import oracle as license_oracle
from tracelake.llm.near_dedup import op9_near_dedup
from tracelake.llm.packing import op6_best_fit_packing
from tracelake.llm.quality_rules import op2_quality_rules
from tracelake.llm.structure_repair import op11_structure_repair
from tracelake.llm.suffix_dedup import ORACLE as SUFFIX_ORACLE
from tracelake.llm.suffix_dedup import op7_suffix_dedup
from tracelake.llm.toxicity import op4_toxicity
from tracelake.llm.url_filters import op3_url_filters
from tracelake.llm.winnowing import op12_winnowing

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_url_filters, op4_toxicity, op5_decontamination, op6_best_fit_packing, op7_suffix_dedup, op8_language_id, op9_near_dedup, op10_html_extraction, op11_structure_repair, op12_winnowing, op13_importance_resampling)}

#: Trained scores, samples, byte strings and packings have no SQL; tests/llm holds them against plain Python.
ORACLES: dict[str, str] = {"op1_license_scan": license_oracle(), "op7_suffix_dedup": SUFFIX_ORACLE}
