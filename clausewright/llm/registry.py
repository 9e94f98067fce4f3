"""The queries of the corpus operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from clausewright.llm.centroids import OP11_SQL, op11_centroids
from clausewright.llm.html_text import op2_html
from clausewright.llm.language import op13_language
from clausewright.llm.lexical import OP12_SQL, op12_lexical
from clausewright.llm.line_dedup import OP3_SQL, op3_line_dedup
from clausewright.llm.media import op10_media
from clausewright.llm.mixing import OP9_SQL, op9_mixing
from clausewright.llm.near_dup import op6_near_dup
from clausewright.llm.packing import op1_packing
from clausewright.llm.secrets import op8_secrets
from clausewright.llm.substring_dedup import op5_substring_dedup
from clausewright.llm.syncmers import op4_fingerprints
from clausewright.llm.toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_packing, op2_html, op3_line_dedup, op4_fingerprints, op5_substring_dedup, op6_near_dup, op7_toxicity, op8_secrets, op9_mixing, op10_media, op11_centroids, op12_lexical, op13_language)}
ORACLES = {"op3_line_dedup": OP3_SQL, "op9_mixing": OP9_SQL, "op11_centroids": OP11_SQL, "op12_lexical": OP12_SQL}
