"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .attention_lm import op9_lm_score
from .decontaminate import op5_decontaminate
from .html_text import op1_html_text
from .jaccard import op7_jaccard_join
from .lines import op3_line_dedup
from .oracles import DECONTAMINATE, JACCARD
from .packing import op2_packing
from .preferences import ORACLE as PREFERENCES
from .preferences import op4_preferences
from .quality import op8_quality
from .secret_scan import op6_secrets
from .toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_preferences": op4_preferences,
    "op5_decontaminate": op5_decontaminate,
    "op6_secrets": op6_secrets,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality": op8_quality,
    "op9_lm_score": op9_lm_score,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {"op4_preferences": PREFERENCES, "op5_decontaminate": DECONTAMINATE, "op7_jaccard_join": JACCARD}
