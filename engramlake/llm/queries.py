"""The queries and SQL of this subpackage's operators, for the driver's entry module."""

from __future__ import annotations

from .op1_licenses import SQL as SQL1, op1_license_scan
from .op2_pii import SQL as SQL2, op2_pii
from .op3_toxicity import op3_toxicity
from .op4_chat import SQL as SQL4, op4_chat
from .op5_gif import op5_gif
from .op6_passages import op6_substring_dedup
from .op7_ngrams import op7_ngram_jaccard
from .op8_lines import SQL as SQL8, op8_line_dedup
from .op9_pieces import op9_sentencepiece
from .op10_tiling import op10_decontamination
from .op11_negatives import SQL as SQL11, op11_hard_negatives
from .op12_repair import SQL as SQL12, op12_conversation_repair
from .op13_tokens import op13_token_counts

_ALL = (
    op1_license_scan, op2_pii, op3_toxicity, op4_chat, op5_gif, op6_substring_dedup, op7_ngram_jaccard, op8_line_dedup, op9_sentencepiece, op10_decontamination,
    op11_hard_negatives, op12_conversation_repair, op13_token_counts,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = SQL1 | SQL2 | SQL4 | SQL8 | SQL11 | SQL12
