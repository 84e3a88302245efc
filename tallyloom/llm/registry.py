"""The queries of this folder by name."""

from __future__ import annotations

from .conversations import op13_conversations
from .decontaminate import op8_decontamination
from .jaccard import op4_jaccard_join
from .langid import op10_language_id
from .licenses import op12_licenses
from .lm import op3_lm_scores
from .mincut import op7_html
from .packing import op1_packing
from .pii import op5_pii
from .resample import ORACLE as RESAMPLING
from .resample import op11_resampling
from .quality import op2_quality
from .secrets import op9_secrets
from .warc import op6_warc

QUERIES = {f.__name__: f for f in (op1_packing, op2_quality, op3_lm_scores, op4_jaccard_join, op5_pii, op6_warc, op7_html, op8_decontamination, op9_secrets, op10_language_id, op11_resampling, op12_licenses, op13_conversations)}
ORACLES: dict[str, str] = {"op11_resampling": RESAMPLING}
