"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from profilion.llm import op01_license, op02_chat, op06_topk, op12_repair, op13_trie
from profilion.llm.op01_license import op1_license
from profilion.llm.op02_chat import op2_chat
from profilion.llm.op03_bpe import op3_bpe
from profilion.llm.op04_mixing import op4_mixing
from profilion.llm.op05_suffix import op5_suffix
from profilion.llm.op06_topk import op6_topk
from profilion.llm.op07_embedding import op7_embedding
from profilion.llm.op08_jaccard import op8_jaccard
from profilion.llm.op09_toxicity import op9_toxicity
from profilion.llm.op10_lm import op10_lm
from profilion.llm.op11_quality import op11_quality


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_license, op2_chat, op3_bpe, op4_mixing, op5_suffix, op6_topk, op7_embedding, op8_jaccard, op9_toxicity, op10_lm, op11_quality, op12_repair.op12_repair, op13_trie.op13_trie)
    return {f.__name__: f for f in each} | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    found = {"op1_license": op01_license.ORACLE, "op2_chat": op02_chat.ORACLE, "op6_topk": op06_topk.ORACLE, "op12_repair": op12_repair.ORACLE, "op13_trie": op13_trie.ORACLE}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
