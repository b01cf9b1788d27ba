"""Registered queries of this subpackage, one for each operator, and of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm.collocations import OP11_SQL, op11_collocations
from wayfold.llm.context_tree import op5_context_tree
from wayfold.llm.html_text import op4_html_blocks
from wayfold.llm.language_id import op7_language_bloom
from wayfold.llm.media import op1_media_jpeg
from wayfold.llm.minhash import op6_minhash_tensor
from wayfold.llm.mixing import op2_mixing_flow
from wayfold.llm.packing import op10_genetic_packing
from wayfold.llm.period_runs import op13_period_runs
from wayfold.llm.search import OP8_SQL, op8_dual_tree
from wayfold.llm.token_counts import op12_rank_merge
from wayfold.llm.url_filter import OP9_SQL, op9_url_filter
from wayfold.llm.warc import OP3_SQL, op3_warc_revisit


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_media_jpeg, op2_mixing_flow, op3_warc_revisit, op4_html_blocks, op5_context_tree, op6_minhash_tensor, op7_language_bloom, op8_dual_tree, op9_url_filter, op10_genetic_packing,
            op11_collocations, op12_rank_merge, op13_period_runs,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_revisit": OP3_SQL, "op8_dual_tree": OP8_SQL, "op9_url_filter": OP9_SQL, "op11_collocations": OP11_SQL}
