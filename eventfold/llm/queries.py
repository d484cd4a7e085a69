"""The subpackage's queries and their SQL."""

from __future__ import annotations

from eventfold.llm.op1_sharding import op1_sharding
from eventfold.llm.op10_toxicity import op10_toxicity
from eventfold.llm.op11_vector_codes import ORACLE as VECTOR_CODES_SQL
from eventfold.llm.op11_vector_codes import op11_vector_codes
from eventfold.llm.op12_collocations import ORACLE as COLLOCATIONS_SQL
from eventfold.llm.op12_collocations import op12_collocations
from eventfold.llm.op13_minhash_dedup import ORACLE as MINHASH_DEDUP_SQL
from eventfold.llm.op13_minhash_dedup import op13_minhash_dedup
from eventfold.llm.op2_quality_rules import op2_quality_rules
from eventfold.llm.op3_chat_formatting import ORACLE as CHAT_FORMATTING_SQL
from eventfold.llm.op3_chat_formatting import op3_chat_formatting
from eventfold.llm.op4_sentencepiece import op4_sentencepiece
from eventfold.llm.op5_pii import op5_pii
from eventfold.llm.op6_media_columns import op6_media_columns
from eventfold.llm.op7_url_filters import ORACLE as URL_FILTERS_SQL
from eventfold.llm.op7_url_filters import op7_url_filters
from eventfold.llm.op8_best_fit_packing import op8_best_fit_packing
from eventfold.llm.op9_jaccard_join import ORACLE as JACCARD_JOIN_SQL
from eventfold.llm.op9_jaccard_join import op9_jaccard_join

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_rules": op2_quality_rules,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_pii": op5_pii,
    "op6_media_columns": op6_media_columns,
    "op7_url_filters": op7_url_filters,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_collocations": op12_collocations,
    "op13_minhash_dedup": op13_minhash_dedup,
}
SQL = {
    "op3_chat_formatting": CHAT_FORMATTING_SQL,
    "op7_url_filters": URL_FILTERS_SQL,
    "op9_jaccard_join": JACCARD_JOIN_SQL,
    "op11_vector_codes": VECTOR_CODES_SQL,
    "op12_collocations": COLLOCATIONS_SQL,
    "op13_minhash_dedup": MINHASH_DEDUP_SQL,
}
