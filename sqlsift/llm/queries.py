"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from sqlsift.llm.chat import OP7_SQL, op7_chat_rotation
from sqlsift.llm.decontaminate import OP1_SQL, op1_decontaminate
from sqlsift.llm.html_extract import op4_html_extract
from sqlsift.llm.langid import op2_language_id
from sqlsift.llm.line_dedup import OP5_SQL, op5_line_dedup
from sqlsift.llm.lm_score import op3_lm_score
from sqlsift.llm.ngram_join import OP10_SQL, op10_ngram_join
from sqlsift.llm.packing import op8_packing
from sqlsift.llm.runs import op11_periodic_runs
from sqlsift.llm.sharding import op9_sharding
from sqlsift.llm.spelling import OP13_SQL, op13_spelling_groups
from sqlsift.llm.token_counts import op12_token_counts
from sqlsift.llm.topk import OP6_SQL, op6_top_k

QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_language_id, op3_lm_score, op4_html_extract, op5_line_dedup, op6_top_k, op7_chat_rotation, op8_packing, op9_sharding, op10_ngram_join, op11_periodic_runs, op12_token_counts, op13_spelling_groups)
}
ORACLES = {"op1_decontaminate": OP1_SQL, "op5_line_dedup": OP5_SQL, "op6_top_k": OP6_SQL, "op7_chat_rotation": OP7_SQL, "op10_ngram_join": OP10_SQL, "op13_spelling_groups": OP13_SQL}
