"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from strandweave.llm import exact_duplicates, language, mixing, near_duplicates, packing, quality, token_counts, url_filters, vector_codes, vectors, warc

QUERIES = {
    "op1_packing": packing.packing_query,
    "op2_url_filters": url_filters.url_filter_query,
    "op3_quality": quality.quality_query,
    "op4_token_counts": token_counts.token_count_query,
    "op5_minhash": near_duplicates.near_duplicate_query,
    "op6_warc_fixity": warc.fixity_query,
    "op7_exact_top_k": vectors.exact_query,
    "op8_mixing": mixing.mixing_query,
    "op9_nearest": vectors.nearest_query,
    "op10_language": language.language_query,
    "op11_exact_duplicates": exact_duplicates.exact_query,
    "op12_vector_codes": vector_codes.code_query,
}
ORACLES = {
    "op2_url_filters": url_filters.URL_FILTER_SQL,
    "op4_token_counts": token_counts.TOKEN_COUNT_SQL,
    "op5_minhash": near_duplicates.NEAR_DUPLICATE_SQL,
    "op6_warc_fixity": warc.FIXITY_SQL,
    "op7_exact_top_k": vectors.EXACT_SQL,
    "op11_exact_duplicates": exact_duplicates.EXACT_DUPLICATE_SQL,
    "op12_vector_codes": vector_codes.CODE_SQL,
}
