"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridhaul.llm import alignment, exact_dedup, html_extract, knn_join, lm_scoring, mixing, packing, quality, simhash, toxicity, url_filter, vector_code, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": lm_scoring.query,
    "op2_html_mincut": html_extract.query,
    "op3_voronoi_knn": knn_join.query,
    "op4_quality_ranking": quality.query,
    "op5_toxicity": toxicity.query,
    "op6_warc_revisits": warc.query,
    "op7_source_mixing": mixing.query,
    "op8_simhash_dedup": simhash.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_best_fit_packing": packing.query,
    "op11_url_range_join": url_filter.query,
    "op12_tokenizer_alignment": alignment.query,
    "op13_cover_tree_codes": vector_code.query,
}
ORACLE_SQL: dict[str, str] = {
    "op3_voronoi_knn": knn_join.ORACLE,
    "op6_warc_revisits": warc.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_url_range_join": url_filter.ORACLE,
    "op13_cover_tree_codes": vector_code.ORACLE,
}
