"""The queries that apply the operators to their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import op6_decontamination
from .hnsw import op7_hnsw
from .license_scan import op9_license_scan
from .line_dedup import op5_line_dedup
from .mixing import op4_mixing
from .near_dedup import op3_near_dedup
from .pitman_yor import op8_pitman_yor
from .quality import op10_quality
from .sharding import op1_sharding
from .sql import ORACLES
from .token_counts import op2_token_counts

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_token_counts": op2_token_counts,
    "op3_near_dedup": op3_near_dedup,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_hnsw": op7_hnsw,
    "op8_pitman_yor": op8_pitman_yor,
    "op9_license_scan": op9_license_scan,
    "op10_quality": op10_quality,
}
