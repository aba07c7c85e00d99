"""The queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from quietlog.llm.decontamination import op1_bm25_decontamination
from quietlog.llm.license_scan import op7_license_scan
from quietlog.llm.near_dedup import op9_dart_minhash_dedup
from quietlog.llm.oracles import ORACLE_SQL
from quietlog.llm.packing import op6_best_fit_packing
from quietlog.llm.sharding import op3_feistel_shards
from quietlog.llm.spotsigs import op8_spotsigs_fingerprints
from quietlog.llm.substring_bwt import op5_suffix_array_dedup
from quietlog.llm.substring_fm import op2_fm_index_dedup
from quietlog.llm.toxicity import op4_ftrl_toxicity
from quietlog.llm.url_filter import op10_url_filter

QUERIES = {f.__name__: f for f in (op1_bm25_decontamination, op2_fm_index_dedup, op3_feistel_shards, op4_ftrl_toxicity, op5_suffix_array_dedup, op6_best_fit_packing, op7_license_scan, op8_spotsigs_fingerprints, op9_dart_minhash_dedup, op10_url_filter)}

__all__ = ["ORACLE_SQL", "QUERIES"]
