"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm.decontamination import op1_decontamination
from veilspark.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from veilspark.llm.html_extraction import op3_html_extraction
from veilspark.llm.line_dedup import OP7_SQL, op7_line_dedup
from veilspark.llm.mixing import op2_mixing
from veilspark.llm.simhash import op5_simhash
from veilspark.llm.substring_dedup import op4_substring_dedup
from veilspark.llm.token_counts import op9_token_counts
from veilspark.llm.toxicity import op8_toxicity
from veilspark.llm.url_filters import OP6_SQL, op6_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_html_extraction": op3_html_extraction,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_url_filters": op6_url_filters,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES: dict[str, str] = {"op6_url_filters": OP6_SQL, "op7_line_dedup": OP7_SQL, "op10_exact_dedup": OP10_SQL}
