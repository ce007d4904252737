"""The registered queries of this subpackage and the DuckDB text of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import decontam, hard_negatives, katz, license_scan, mixing, near_dup, pii, quality, token_count, topk, toxicity, warc, whitening

QUERIES = {
    "op1_benchmark_copies": decontam.op1,
    "op2_top_k": topk.op2,
    "op3_katz_scores": katz.op3,
    "op4_token_counts": token_count.op4,
    "op5_mix_sources": mixing.op5,
    "op6_license_scan": license_scan.op6,
    "op7_quality": quality.op7,
    "op8_personal_data": pii.op8,
    "op9_near_duplicates": near_dup.op9,
    "op10_toxicity": toxicity.op10,
    "op11_whitening": whitening.op11,
    "op12_warc_archives": warc.op12,
    "op13_hard_negatives": hard_negatives.op13,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op2_top_k": topk.OP2_SQL, "op12_warc_archives": warc.OP12_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
