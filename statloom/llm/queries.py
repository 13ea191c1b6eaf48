"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from statloom.llm.q_bpe import op2_bpe
from statloom.llm.q_capfilters import OP8_SQL, op8_embedding_neardup
from statloom.llm.q_htmltext import op5_html_text
from statloom.llm.q_linededup import op9_line_dedup
from statloom.llm.q_mixing import OP1_SQL, op1_mixing
from statloom.llm.q_ngramjoin import OP10_SQL, op10_ngram_join
from statloom.llm.q_packing import op3_packing
from statloom.llm.q_pii import op4_pii
from statloom.llm.q_topk import OP6_SQL, op6_topk
from statloom.llm.q_toxicity import op7_toxicity

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_bpe": op2_bpe,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_html_text": op5_html_text,
    "op6_topk": op6_topk,
    "op7_toxicity": op7_toxicity,
    "op8_embedding_neardup": op8_embedding_neardup,
    "op9_line_dedup": op9_line_dedup,
    "op10_ngram_join": op10_ngram_join,
}
SQL = {"op1_mixing": OP1_SQL, "op6_topk": OP6_SQL, "op8_embedding_neardup": OP8_SQL, "op10_ngram_join": OP10_SQL}
