"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import oracle
from docketry.llm.conversations import q_conversations
from docketry.llm.decontaminate import q_decontaminate
from docketry.llm.language import q_language
from docketry.llm.merkle import q_merkle
from docketry.llm.mixing import q_mixing
from docketry.llm.near_dedup import q_near_dedup
from docketry.llm.packing import q_packing
from docketry.llm.personal_data import q_personal_data
from docketry.llm.sharding import q_sharding
from docketry.llm.substring_dedup import q_substring_dedup
from docketry.llm.token_files import q_token_files
from docketry.llm.toxicity import q_toxicity
from docketry.llm.vector_tree import q_vector_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": q_toxicity,
    "op2_substring_dedup": q_substring_dedup,
    "op3_token_files": q_token_files,
    "op4_language": q_language,
    "op5_packing": q_packing,
    "op6_sharding": q_sharding,
    "op7_vector_tree": q_vector_tree,
    "op8_personal_data": q_personal_data,
    "op9_near_dedup": q_near_dedup,
    "op10_decontamination": q_decontaminate,
    "op11_conversations": q_conversations,
    "op12_mixing": q_mixing,
    "op13_merkle": q_merkle,
}

ORACLE: dict[str, str] = {
    "op2_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op9_near_dedup": oracle.NEAR_DEDUP,
    "op10_decontamination": oracle.DECONTAMINATION,
    "op11_conversations": oracle.CONVERSATIONS,
    "op12_mixing": oracle.MIXING,
    "op13_merkle": oracle.MERKLE,
}
