"""The registered queries of the thirteen operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trajloom.llm import decontam, divergence, infill, langid, licenses, neardup, ngram_lm, packing, quality, sharding, token_store, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.packed_documents,
    "op2_sharding": sharding.shard_documents,
    "op3_license_scan": licenses.license_documents,
    "op4_decontamination": decontam.leaked_documents,
    "op5_near_duplicates": neardup.document_classes,
    "op6_ngram_scores": ngram_lm.scored_documents,
    "op7_exact_topk": topk.nearest_embeddings,
    "op8_language_id": langid.identify_documents,
    "op9_warc": warc.archived_pages,
    "op10_token_files": token_store.token_documents,
    "op11_source_divergence": divergence.audited_sources,
    "op12_quality_rules": quality.judged_documents,
    "op13_fill_in_middle": infill.infill_documents,
}

ORACLES: dict[str, str] = {
    "op7_exact_topk": topk.ORACLE,
    "op9_warc": warc.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op13_fill_in_middle": infill.ORACLE,
}
