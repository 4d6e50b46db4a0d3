"""Registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op4_bpe
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .importance import op13_importance
from .langid import op5_langid
from .lexical_search import OP11_SQL, op11_lexical_search
from .mixing import OP9_SQL, op9_mixing
from .pii import op2_pii
from .quality_classifier import op10_quality_classifier
from .quality_rules import op6_quality_rules
from .sharding import op7_sharding
from .simhash import op1_simhash
from .token_files import op12_token_files
from .toxicity import op3_toxicity

QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_pii, op3_toxicity, op4_bpe, op5_langid, op6_quality_rules, op7_sharding, op8_exact_dedup, op9_mixing, op10_quality_classifier,
    op11_lexical_search, op12_token_files, op13_importance)}
ORACLES = {"op8_exact_dedup": OP8_SQL, "op9_mixing": OP9_SQL, "op11_lexical_search": OP11_SQL}
