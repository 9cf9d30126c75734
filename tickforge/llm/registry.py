"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import decontaminate, flac, jaccard_join, pieces, prefix_trie, quality, secret_scan, sharding, suffix_dedup, token_counts, url_filter, warc, whitening

QUERIES = {
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op1_quality": quality.op1_quality,
    "op3_flac": flac.op3_flac,
    "op10_warc": warc.op10_warc,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_pieces": pieces.op5_pieces,
    "op6_url_filter": url_filter.op6_url_filter,
    "op8_sharding": sharding.op8_sharding,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE_SQL = {"op7_jaccard_join": jaccard_join.OP7_SQL, "op10_warc": warc.OP10_SQL, "op6_url_filter": url_filter.OP6_SQL, "op11_prefix_trie": prefix_trie.OP11_SQL}
