"""The queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from tapeloom.llm.divergence import OP13_SQL, op13_query
from tapeloom.llm.embedding_dedup import op5_query
from tapeloom.llm.language_id import op6_query
from tapeloom.llm.license_scan import op8_query
from tapeloom.llm.line_dedup import OP9_SQL, op9_query
from tapeloom.llm.merkle import OP12_SQL, op12_query
from tapeloom.llm.minhash_dedup import op10_query
from tapeloom.llm.mixing import OP2_SQL, op2_query
from tapeloom.llm.packing import op1_query
from tapeloom.llm.quality_classifier import op4_query
from tapeloom.llm.quality_rules import OP7_SQL, op7_query
from tapeloom.llm.sharding import op3_query
from tapeloom.llm.substring_dedup import op11_query

QUERIES = {
    "op1_packing": op1_query,
    "op2_mixing": op2_query,
    "op3_sharding": op3_query,
    "op4_quality_classifier": op4_query,
    "op5_embedding_dedup": op5_query,
    "op6_language_id": op6_query,
    "op7_quality_rules": op7_query,
    "op8_license_scan": op8_query,
    "op9_line_dedup": op9_query,
    "op10_minhash_dedup": op10_query,
    "op11_substring_dedup": op11_query,
    "op12_merkle_manifest": op12_query,
    "op13_source_divergence": op13_query,
}

ORACLE_SQL = {"op2_mixing": OP2_SQL, "op7_quality_rules": OP7_SQL, "op9_line_dedup": OP9_SQL, "op12_merkle_manifest": OP12_SQL, "op13_source_divergence": OP13_SQL}
