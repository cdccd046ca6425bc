"""Thresholds of the document pipeline. Each is a parameter; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    native_page_chars: int = 50
    native_page_share: float = 0.3
    chunk_chars: int = 1800
    chunk_overlap: int = 350
    small_chunk: int = 80
    large_chunk: int = 8000
    embed_chars: int = 1500
    code_lines: int = 50
    code_overlap: int = 10
    top_k: int = 5
    context_chars: int = 10_000
    table_min: int = 2
    repeat_min_pages: int = 3
    repeat_min_chars: int = 10
    max_query_chars: int = 500
    min_answer_chars: int = 20
    max_answer_chars: int = 3000
    min_grounding: float = 0.15
    low_confidence: float = 0.70


DEFAULT = Config()

#: What a refusal contains.
REFUSAL = "couldn't find enough information"
