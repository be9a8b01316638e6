"""The registered queries of this subpackage and the DuckDB SQL of those SQL can express."""

from __future__ import annotations

import corpus_pipeline
from chunkgraph.llm import (bpe, conversation_repair, importance, langid, license_scan, line_dedup, lm,
                            mixing, oph, quality_rules, simhash, substring, url_filter)
from chunkgraph.llm.oracles import ORACLES  # noqa: F401

QUERIES = {
    "op1_oph_fingerprints": oph.op1_oph_fingerprints,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_language_id": langid.op4_language_id,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_lm_scores": lm.op8_lm_scores,
    "op9_simhash_dedup": simhash.op9_simhash_dedup,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_substring_dedup": substring.op13_substring_dedup,
    "pipeline": corpus_pipeline.run,
}
