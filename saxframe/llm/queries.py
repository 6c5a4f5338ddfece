"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from saxframe.llm.decontaminate import op3_decontamination
from saxframe.llm.html import op4_html_extraction
from saxframe.llm.lines import op5_line_dedup
from saxframe.llm.mixing import OP8_SQL, op8_mixing
from saxframe.llm.passages import op9_passage_dedup
from saxframe.llm.quality import op10_quality_classifier
from saxframe.llm.scoring import op1_lm_scoring
from saxframe.llm.simhash import op6_simhash_near_dedup
from saxframe.llm.suffixes import OP2_SQL, op2_suffix_array_dedup
from saxframe.llm.vectors import OP7_SQL, op7_embedding_near_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_html_extraction": op4_html_extraction,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_mixing": op8_mixing,
    "op9_passage_dedup": op9_passage_dedup,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_array_dedup": OP2_SQL,
    "op7_embedding_near_dedup": OP7_SQL,
    "op8_mixing": OP8_SQL,
}
