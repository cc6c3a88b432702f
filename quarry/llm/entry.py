"""Queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, dialogue, language, lm, maxscore, near_dup, packing, sharding, substring, token_file, topk, toxicity, vectors

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_near_dup": near_dup.op2_near_dup,
    "op3_substring_dedup": substring.op3_substring_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_lm_score": lm.op5_lm_score,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_language": language.op7_language,
    "op8_sharding": sharding.op8_sharding,
    "op9_embedding_dedup": vectors.op9_embedding_dedup,
    "op10_token_binary": token_file.op10_token_binary,
    "op11_lexical_search": maxscore.op11_lexical_search,
    "op12_structure_repair": dialogue.op12_structure_repair,
    "op13_topk_search": topk.op13_topk_search,
}
SQL = {"op3_substring_dedup": substring.OP3_SQL, "op6_decontamination": decontaminate.OP6_SQL, "op9_embedding_dedup": vectors.OP9_SQL, "op11_lexical_search": maxscore.OP11_SQL, "op12_structure_repair": dialogue.OP12_SQL, "op13_topk_search": topk.OP13_SQL}
