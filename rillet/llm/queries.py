"""The registered queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from rillet.llm import ann, decontaminate, lines
from rillet.llm.ann import op2_block_knn
from rillet.llm.decontaminate import op4_suffix_automaton
from rillet.llm.langid import op1_language_spans
from rillet.llm.lines import op10_deletion_join
from rillet.llm.packing import op7_best_two_fit
from rillet.llm.passages import op5_seed_chains
from rillet.llm.quality import op9_quality_pu
from rillet.llm.sharding import op8_flow_reshard
from rillet.llm.simhash import op3_simhash_anchors
from rillet.llm.substrings import op6_suffix_sort

QUERIES = {
    "op1_language_spans": op1_language_spans,
    "op2_block_knn": op2_block_knn,
    "op3_simhash_anchors": op3_simhash_anchors,
    "op4_suffix_automaton": op4_suffix_automaton,
    "op5_seed_chains": op5_seed_chains,
    "op6_suffix_sort": op6_suffix_sort,
    "op7_best_two_fit": op7_best_two_fit,
    "op8_flow_reshard": op8_flow_reshard,
    "op9_quality_pu": op9_quality_pu,
    "op10_deletion_join": op10_deletion_join,
}
ORACLES: dict[str, str] = {
    "op2_block_knn": ann.ORACLE,
    "op4_suffix_automaton": decontaminate.ORACLE,
    "op10_deletion_join": lines.ORACLE,
}
