"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import extraction, licenses, line_dedup, media, mixing, ngram_join, packing, quality, sharding, token_file

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_kd_sharding": sharding.op4_kd_sharding,
    "op5_pack_nnls": packing.op5_pack_nnls,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_interleaved_media": media.op8_interleaved_media,
    "op9_tree_extraction": extraction.op9_tree_extraction,
    "op10_huffman_tokens": token_file.op10_huffman_tokens,
}
ORACLES = {
    "op2_quality_rules": quality.ORACLE,
    "op3_mix_sources": mixing.ORACLE,
    "op4_kd_sharding": sharding.ORACLE,
    "op6_ngram_join": ngram_join.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_interleaved_media": media.ORACLE,
}
