"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from cohortloom.llm.chat import OP7_SQL, op7_format_chat
from cohortloom.llm.embeddings import OP10_SQL, op10_near_vectors
from cohortloom.llm.fingerprint import op9_fingerprints
from cohortloom.llm.language import op5_language
from cohortloom.llm.minhash import OP4_SQL, op4_near_duplicates
from cohortloom.llm.mixing import op1_mix_sources
from cohortloom.llm.pii import op2_private
from cohortloom.llm.quality import op3_quality
from cohortloom.llm.segmentation import op8_segment
from cohortloom.llm.toxicity import op6_toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_mix_sources": op1_mix_sources,
    "op2_private": op2_private,
    "op3_quality": op3_quality,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language": op5_language,
    "op6_toxicity": op6_toxicity,
    "op7_format_chat": op7_format_chat,
    "op8_segment": op8_segment,
    "op9_fingerprints": op9_fingerprints,
    "op10_near_vectors": op10_near_vectors,
}
ORACLE_SQL: dict[str, str] = {
    "op4_near_duplicates": OP4_SQL,
    "op7_format_chat": OP7_SQL,
    "op10_near_vectors": OP10_SQL,
}
