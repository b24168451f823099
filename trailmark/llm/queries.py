"""The corpus operators' queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import centroids, conversation_repair, decontaminate, exact_dedup, langid, packing, pii, sharding
from . import simhash, substring_dedup, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_simhash": simhash.op3_simhash,
    "op4_language_id": langid.op4_language_id,
    "op5_packing": packing.op5_packing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_warc": warc.op7_warc,
    "op8_pii": pii.op8_pii,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_centroids": centroids.op12_centroids,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}

ORACLE_SQL = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op7_warc": warc.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_conversation_repair": conversation_repair.ORACLE,
    "op12_centroids": centroids.ORACLE,
}
