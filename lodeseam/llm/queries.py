"""The queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from lodeseam.llm.byte_bpe import op8_byte_bpe
from lodeseam.llm.html_extraction import op6_html_extraction
from lodeseam.llm.line_dedup import OP1_SQL, op1_line_dedup
from lodeseam.llm.packing import op4_best_fit_packing
from lodeseam.llm.sharding import op10_jump_shards
from lodeseam.llm.simhash_dedup import op9_simhash_near_dedup
from lodeseam.llm.substring_dedup import op5_substring_dedup
from lodeseam.llm.slack_packing import op12_slack_packing
from lodeseam.llm.spelling_variants import OP11_SQL, op11_spelling_variants
from lodeseam.llm.topk_search import OP2_SQL, op2_fagin_topk
from lodeseam.llm.toxicity import op7_toxicity
from lodeseam.llm.vp_tree import op3_vp_tree_neighbours

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_fagin_topk, op3_vp_tree_neighbours, op4_best_fit_packing, op5_substring_dedup,
        op6_html_extraction, op7_toxicity, op8_byte_bpe, op9_simhash_near_dedup, op10_jump_shards, op11_spelling_variants, op12_slack_packing,
    )
}
ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op2_fagin_topk": OP2_SQL, "op11_spelling_variants": OP11_SQL}
