"""Queries of this subpackage, one per operator, and their SQL where DuckDB can express them."""

from __future__ import annotations

from .bpe import op5_byte_bpe
from .decontaminate import op7_decontaminate
from .html_text import op4_html_text
from .jaccard_join import op3_jaccard_join
from .kd_shards import op8_kd_shards
from .lexical_search import op13_lexical_search
from .merkle import op12_merkle_manifest
from .oracle import ORACLE
from .pii import op6_pii
from .quality_model import op10_quality_model
from .quality_rules import op2_quality_rules
from .substring_dedup import op9_substring_dedup
from .suffix_array import op11_suffix_dedup
from .url_filters import op1_url_filters

QUERIES = {f.__name__: f for f in (op1_url_filters, op2_quality_rules, op3_jaccard_join, op4_html_text, op5_byte_bpe, op6_pii, op7_decontaminate, op8_kd_shards, op9_substring_dedup, op10_quality_model, op11_suffix_dedup, op12_merkle_manifest, op13_lexical_search)}

__all__ = ["ORACLE", "QUERIES"]
