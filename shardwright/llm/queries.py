"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from shardwright.llm.chat import OP2_SQL, op2_chat_formatting
from shardwright.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from shardwright.llm.hf_backend import op7_sentencepiece
from shardwright.llm.langid import op1_language_id
from shardwright.llm.lsh_forest import op6_ngram_join
from shardwright.llm.mixing import op9_mixing
from shardwright.llm.pii import op8_personal_data
from shardwright.llm.spotsigs import op3_spotsigs
from shardwright.llm.toxicity import op5_toxicity
from shardwright.llm.unigram_count import op4_token_counts

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_spotsigs": op3_spotsigs,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_join": op6_ngram_join,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_personal_data": op8_personal_data,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
}

SQL = {
    "op2_chat_formatting": OP2_SQL,
    "op10_exact_dedup": OP10_SQL,
}
