"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taskloom.llm.bpe import op6_bpe
from taskloom.llm.decontamination import OP4_SQL, op4_decontamination
from taskloom.llm.divergence import OP12_SQL, op12_divergence
from taskloom.llm.jaccard import OP7_SQL, op7_jaccard
from taskloom.llm.lines import OP10_SQL, op10_lines
from taskloom.llm.merkle import OP11_SQL, op11_manifest
from taskloom.llm.neighbours import op13_neighbours
from taskloom.llm.perplexity import op9_quality
from taskloom.llm.pii import op1_pii
from taskloom.llm.substring import OP2_SQL, op2_substrings
from taskloom.llm.toxicity import op8_toxicity
from taskloom.llm.topk import OP3_SQL, op3_topk
from taskloom.llm.sharding import op5_shards


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pii": op1_pii, "op2_substrings": op2_substrings, "op3_topk": op3_topk, "op4_decontamination": op4_decontamination, "op5_shards": op5_shards, "op6_bpe": op6_bpe, "op7_jaccard": op7_jaccard, "op8_toxicity": op8_toxicity, "op9_quality": op9_quality, "op10_lines": op10_lines, "op11_manifest": op11_manifest, "op12_divergence": op12_divergence, "op13_neighbours": op13_neighbours}


def oracle_sql() -> dict[str, str]:
    return {"op2_substrings": OP2_SQL, "op3_topk": OP3_SQL, "op4_decontamination": OP4_SQL, "op7_jaccard": OP7_SQL, "op10_lines": OP10_SQL, "op11_manifest": OP11_SQL, "op12_divergence": OP12_SQL}
