"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocation, language, neighbours, packing, personal, pieces, ranking, repetition, resampling, sharding, similarity, toxicity, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        toxicity.op1_subsequence_kernel,
        sharding.op2_weighted_hash_tree,
        language.op3_partial_matching,
        personal.op4_semi_markov_field,
        similarity.op5_chosen_paths,
        neighbours.op6_one_bit_codes,
        packing.op7_large_item_matching,
        repetition.op8_suffix_repetition,
        resampling.op9_importance_resampling,
        pieces.op10_offset_pieces,
        winnowing.op11_winnowing,
        ranking.op12_block_max_wand,
        collocation.op13_bucketed_phrases,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op11_winnowing": winnowing.OP11_SQL,
    "op12_block_max_wand": ranking.OP12_SQL,
    "op13_bucketed_phrases": collocation.OP13_SQL,
}
