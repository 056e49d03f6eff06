"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from gridstats.llm import (adaptive_scan, collocations, external_shuffle, importance, itq_dedup, langid, mixing, packing, pii,
                           secret_scan, simhash, suffix_dedup, token_files)

QUERIES = {
    "op1_secret_scan": secret_scan.secret_scan,
    "op2_packing": packing.packing,
    "op3_external_shuffle": external_shuffle.sharding,
    "op4_itq_dedup": itq_dedup.embedding_dedup,
    "op5_adaptive_scan": adaptive_scan.nearest,
    "op6_pii": pii.pii,
    "op7_mixing": mixing.mixing,
    "op8_suffix_dedup": suffix_dedup.repeated_passages,
    "op9_simhash": simhash.simhash,
    "op10_language_id": langid.language_id,
    "op11_collocations": collocations.collocations,
    "op12_importance": importance.importance,
    "op13_token_files": token_files.token_files,
}
ORACLES = {"op1_secret_scan": secret_scan.SQL.strip(), "op11_collocations": collocations.SQL.strip()}
