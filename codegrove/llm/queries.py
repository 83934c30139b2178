"""Queries of this subpackage for the registry at the top of the repository."""

from __future__ import annotations

from . import mixing, quality
from .embeddings import op7_embedding_dedup
from .fingerprints import op3_fingerprints
from .html_text import op6_html_extraction
from .language_id import op8_language_id
from .licenses import op9_license_scan
from .packing import op5_packing
from .simhash import op10_simhash
from .token_counts import op4_token_counts

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_mixing": mixing.op2_mixing,
    "op3_fingerprints": op3_fingerprints,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_html_extraction": op6_html_extraction,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_simhash": op10_simhash,
}
ORACLE_SQL: dict[str, str] = {"op1_quality": quality.oracle(), "op2_mixing": mixing.oracle()}
