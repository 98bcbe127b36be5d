"""The subpackage's queries for the driver contract, and their SQL where SQL can express them."""

from __future__ import annotations

from furrow.llm.chat import OP13_SQL, op13_chat_formatting
from furrow.llm.decontaminate import op9_benchmark_decontamination
from furrow.llm.filter_audit import OP11_SQL, op11_filter_audit
from furrow.llm.hmm import op10_lm_scoring
from furrow.llm.jaccard import OP5_SQL, op5_ngram_jaccard_join
from furrow.llm.mixing import op6_mixing
from furrow.llm.quality import op3_quality_classifier
from furrow.llm.repair import OP12_SQL, op12_conversation_repair
from furrow.llm.rules import op8_quality_rules
from furrow.llm.secrets import op4_secret_scans
from furrow.llm.sharding import op2_sharding
from furrow.llm.substring import OP7_SQL, op7_substring_dedup
from furrow.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_sharding": op2_sharding,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_secret_scans": op4_secret_scans,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_filter_audit": op11_filter_audit,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_chat_formatting": op13_chat_formatting,
}

#: For tables of the size that the queries are compared on; the joins of shingles and windows are not for large ones.
ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op7_substring_dedup": OP7_SQL, "op11_filter_audit": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_chat_formatting": OP13_SQL}
