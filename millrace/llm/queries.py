"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .alignment import op12_alignment
from .fingerprints import op3_fingerprints
from .langid import op9_language_id
from .licenses import op4_license_scan
from .lmscore import op5_lm_scores
from .media import op10_media_copies
from .mixing import op1_mixing
from .neardup import op7_order_minhash
from .packing import op6_packing
from .phrases import ORACLE as PHRASES, op11_phrases
from .secrets import op13_secrets
from .sharding import op2_sharding
from .tokencount import op8_token_counts

QUERIES = {"op1_mixing": op1_mixing, "op2_sharding": op2_sharding, "op3_fingerprints": op3_fingerprints, "op4_license_scan": op4_license_scan, "op5_lm_scores": op5_lm_scores, "op6_packing": op6_packing, "op7_order_minhash": op7_order_minhash, "op8_token_counts": op8_token_counts, "op9_language_id": op9_language_id, "op10_media_copies": op10_media_copies, "op11_phrases": op11_phrases, "op12_alignment": op12_alignment, "op13_secrets": op13_secrets}
ORACLES: dict[str, str] = {"op11_phrases": PHRASES}
