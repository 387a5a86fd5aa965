"""The registered queries of this folder."""

from __future__ import annotations

from sievework.llm import op1_topk as op1
from sievework.llm import op5_chat as op5
from sievework.llm import op12_ranked as op12
from sievework.llm.op2_ann import op2_ann
from sievework.llm.op10_html import op10_html
from sievework.llm.op11_runs import op11_runs
from sievework.llm.op13_rules import op13_rules
from sievework.llm.op3_quality import op3_quality
from sievework.llm.op4_substring import op4_substring
from sievework.llm.op6_jaccard import op6_jaccard
from sievework.llm.op7_language import op7_language
from sievework.llm.op8_packing import op8_packing
from sievework.llm.op9_bpe import op9_bpe

QUERIES = {
    "op1_topk": op1.op1_topk,
    "op2_ann": op2_ann,
    "op3_quality": op3_quality,
    "op4_substring": op4_substring,
    "op5_chat": op5.op5_chat,
    "op6_jaccard": op6_jaccard,
    "op7_language": op7_language,
    "op8_packing": op8_packing,
    "op9_bpe": op9_bpe,
    "op10_html": op10_html,
    "op11_runs": op11_runs,
    "op12_ranked": op12.op12_ranked,
    "op13_rules": op13_rules,
    "chat_quoted": op5.chat_quoted,
}
ORACLES: dict[str, str] = {
    "op1_topk": op1.ORACLE,
    "op5_chat": op5.ORACLE,
    "chat_quoted": op5.QUOTED_ORACLE,
    "op12_ranked": op12.ORACLE,
}
