"""Queries of the corpus operators, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, fim, trie
from .bpe import op13_byte_bpe
from .chat import op6_chat_formatting
from .fim import op12_fill_in_middle
from .fingerprints import op9_document_fingerprints
from .license import op7_license_scan
from .mixing import op3_mixing_pareto
from .neardup import op5_minhash_near_dedup
from .packing import op10_best_fit_packing
from .pii import op2_pii_skip_chain
from .quality import op8_quality_rules
from .tokens import op4_token_files
from .toxicity import op1_toxicity_ftrl
from .trie import op11_conversation_trie

_QUERIES = [
    op1_toxicity_ftrl,
    op2_pii_skip_chain,
    op3_mixing_pareto,
    op4_token_files,
    op5_minhash_near_dedup,
    op6_chat_formatting,
    op7_license_scan,
    op8_quality_rules,
    op9_document_fingerprints,
    op10_best_fit_packing,
    op11_conversation_trie,
    op12_fill_in_middle,
    op13_byte_bpe,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_formatting": chat.ORACLE_SQL, "op11_conversation_trie": trie.ORACLE_SQL, "op12_fill_in_middle": fim.ORACLE_SQL}
