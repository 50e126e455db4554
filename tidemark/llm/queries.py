"""Registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.class_lm import op1_class_lm
from tidemark.llm.collocations import ORACLE as COLLOCATIONS_SQL
from tidemark.llm.collocations import op11_collocations
from tidemark.llm.common import ship
from tidemark.llm.decontamination import op2_decontamination
from tidemark.llm.embedding_join import op9_embedding_pigeonhole
from tidemark.llm.language_id import op7_language_id
from tidemark.llm.mixing import ORACLE as MIXING_SQL
from tidemark.llm.mixing import op4_mix_schedule
from tidemark.llm.ngram_join import op8_ngram_jaccard
from tidemark.llm.secret_scan import op12_secret_scan
from tidemark.llm.token_counts import op5_token_counts
from tidemark.llm.token_output import op10_token_output
from tidemark.llm.toxicity import op6_toxicity_chain
from tidemark.llm.turn_repair import op13_turn_repair
from tidemark.llm.url_filter import ORACLE as URL_FILTER_SQL
from tidemark.llm.url_filter import op3_url_reputation


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: _shipped(q) for q in (
        op1_class_lm, op2_decontamination, op3_url_reputation, op4_mix_schedule, op5_token_counts, op6_toxicity_chain, op7_language_id, op8_ngram_jaccard, op9_embedding_pigeonhole,
        op10_token_output, op11_collocations, op12_secret_scan, op13_turn_repair,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_mix_schedule": MIXING_SQL,
    "op3_url_reputation": URL_FILTER_SQL,
    "op11_collocations": COLLOCATIONS_SQL,
}
