"""Queries of the training-data operators and their DuckDB text."""

from __future__ import annotations

from signalframe.llm.bpe import op1_bpe_encode
from corpus_pipeline import ORACLE_SQL, run
from signalframe.llm.bottomk import op6_fingerprints
from signalframe.llm.chat_tree import OP3_SQL, op3_chat_tree
from signalframe.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from signalframe.llm.language_crf import op5_language_id
from signalframe.llm.license_scan import op8_license_scan
from signalframe.llm.merkle import OP12_SQL, op12_merkle_manifest
from signalframe.llm.mixing import OP9_SQL, op9_mix_sources
from signalframe.llm.simhash import op2_simhash_dedup
from signalframe.llm.substring_dedup import op7_substring_dedup
from signalframe.llm.suffix_dedup import op11_suffix_dedup
from signalframe.llm.surrogates import op4_pii_surrogates
from signalframe.llm.token_align import op13_token_align

LLM_QUERIES = {
    "op1_bpe_encode": op1_bpe_encode,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_chat_tree": op3_chat_tree,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_language_id": op5_language_id,
    "op6_fingerprints": op6_fingerprints,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_mix_sources": op9_mix_sources,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_align": op13_token_align,
    "pipeline": run,
}

LLM_ORACLES = {
    "op3_chat_tree": OP3_SQL,
    "op9_mix_sources": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
if ORACLE_SQL:
    LLM_ORACLES["pipeline"] = ORACLE_SQL
