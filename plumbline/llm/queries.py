"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op8_byte_bpe
from .language import op4_language_id
from .licenses import op7_license_scans
from .lm import op2_lm_scoring
from .media import op9_media_columns
from .neardup import op3_minhash_near_dedup, op3_sql
from .packing import op5_best_fit_packing
from .quality import op1_quality_rules
from .secrets import op6_secret_scans
from .urls import op10_sql, op10_url_filters

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_lm_scoring, op3_minhash_near_dedup, op4_language_id, op5_best_fit_packing, op6_secret_scans, op7_license_scans, op8_byte_bpe, op9_media_columns, op10_url_filters)}
ORACLE_SQL: dict[str, str] = {"op3_minhash_near_dedup": op3_sql(), "op10_url_filters": op10_sql()}
