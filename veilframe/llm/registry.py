"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm.chat import OP2_SQL, op2_chat_prefix_targets
from veilframe.llm.graph_search import op3_ann_pruned_graph
from veilframe.llm.hmm import op1_hmm_language_model
from veilframe.llm.mixing import op6_mix_sources
from veilframe.llm.ngram_join import op5_ngram_jaccard_join
from veilframe.llm.packing import op8_pack_sequences
from veilframe.llm.pivot_search import OP7_SQL, op7_topk_pivot_table
from veilframe.llm.quality import op9_quality_rff
from veilframe.llm.tokens import op4_section_token_counts
from veilframe.llm.toxicity import op10_toxicity_noisy_channel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hmm_language_model, op2_chat_prefix_targets, op3_ann_pruned_graph, op4_section_token_counts, op5_ngram_jaccard_join,
        op6_mix_sources, op7_topk_pivot_table, op8_pack_sequences, op9_quality_rff, op10_toxicity_noisy_channel,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_chat_prefix_targets": OP2_SQL, "op7_topk_pivot_table": OP7_SQL}
