"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from capture_analytics.llm.bpe import op9_byte_bpe
from capture_analytics.llm.brown import op4_lm_scoring
from capture_analytics.llm.collocations import COLLOCATIONS_SQL, op13_collocations
from capture_analytics.llm.fmindex import op8_fm_decontamination
from capture_analytics.llm.idfiles import op2_token_files
from capture_analytics.llm.jaccard import op5_jaccard_join
from capture_analytics.llm.langid import op10_language_id
from capture_analytics.llm.licenses import op3_license_scan
from capture_analytics.llm.phrases import op6_substring_dedup
from capture_analytics.llm.topk import TOPK_SQL, op1_topk_search
from capture_analytics.llm.toxic import op7_toxicity
from capture_analytics.llm.variants import VARIANTS_SQL, op12_spelling_variants
from capture_analytics.llm.vptree import op11_nearest_neighbours

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_topk_search,
        op2_token_files,
        op3_license_scan,
        op4_lm_scoring,
        op5_jaccard_join,
        op6_substring_dedup,
        op7_toxicity,
        op8_fm_decontamination,
        op9_byte_bpe,
        op10_language_id,
        op11_nearest_neighbours,
        op12_spelling_variants,
        op13_collocations,
    )}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES: dict[str, str] = {
    "op1_topk_search": TOPK_SQL,
    "op12_spelling_variants": VARIANTS_SQL,
    "op13_collocations": COLLOCATIONS_SQL,
}
