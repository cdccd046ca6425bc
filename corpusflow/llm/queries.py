"""Registry of the corpus operators: one query each over its whole table, and DuckDB SQL for those that SQL can express;
the others are held against brute force in tests/llm."""

from __future__ import annotations

from corpusflow.llm.ann import op1_projected_neighbours
from corpusflow.llm.audit import op12_filter_audit
from corpusflow.llm.chat import op4_chat_formatting
from corpusflow.llm.exactdup import op11_bloom_exact_dedup
from corpusflow.llm.htmltext import op5_html_extraction
from corpusflow.llm.linededup import op8_line_templates
from corpusflow.llm.neardup import op3_minhash_neardup
from corpusflow.llm.oracles import ORACLES
from corpusflow.llm.packing import op7_best_fit_packing
from corpusflow.llm.quality import op9_adaptive_quality
from corpusflow.llm.resample import op13_importance_resampling
from corpusflow.llm.sentpiece import op2_sentencepiece
from corpusflow.llm.substrings import op10_substring_dedup
from corpusflow.llm.tokenfiles import op6_token_id_files

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_projected_neighbours": op1_projected_neighbours,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_minhash_neardup": op3_minhash_neardup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_html_extraction": op5_html_extraction,
    "op6_token_id_files": op6_token_id_files,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_line_templates": op8_line_templates,
    "op9_adaptive_quality": op9_adaptive_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_bloom_exact_dedup": op11_bloom_exact_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_importance_resampling": op13_importance_resampling,
}
