"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .conversations import op12_repair_conversations
from .decontaminate import op1_greedy_tiling
from .exact_dedup import ORACLE_OP5, op5_polynomial_dedup
from .html_extract import op6_crf_main_text
from .licenses import op9_prefix_join_licenses, oracle_op9
from .media import op13_media_archive
from .mixing import ORACLE_OP10, op10_weighted_fair_mix
from .sharding import ORACLE_SHARD_COUNTS, op2_bounded_ring, shard_counts
from .simhash import op7_simhash_pivots
from .toxicity import op4_gated_recurrent
from .url_filter import op3_link_propagation, oracle_op3
from .warc import ORACLE_OP8, op8_segmented_warc
from .whitening import op11_whitened_embeddings

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_greedy_tiling": op1_greedy_tiling,
    "op2_bounded_ring": op2_bounded_ring,
    "op3_link_propagation": op3_link_propagation,
    "op4_gated_recurrent": op4_gated_recurrent,
    "op5_polynomial_dedup": op5_polynomial_dedup,
    "op6_crf_main_text": op6_crf_main_text,
    "op7_simhash_pivots": op7_simhash_pivots,
    "op8_segmented_warc": op8_segmented_warc,
    "op9_prefix_join_licenses": op9_prefix_join_licenses,
    "op10_weighted_fair_mix": op10_weighted_fair_mix,
    "op11_whitened_embeddings": op11_whitened_embeddings,
    "op12_repair_conversations": op12_repair_conversations,
    "op13_media_archive": op13_media_archive,
    "shard_counts": shard_counts,
}
ORACLES = {"shard_counts": ORACLE_SHARD_COUNTS, "op3_link_propagation": oracle_op3(), "op5_polynomial_dedup": ORACLE_OP5, "op8_segmented_warc": ORACLE_OP8, "op9_prefix_join_licenses": oracle_op9(), "op10_weighted_fair_mix": ORACLE_OP10}
