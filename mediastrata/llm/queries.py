"""The corpus operators' registered queries and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from mediastrata.llm import bpe, html_extract, langid, licenses, packing, quality, simhash, tokenfile, toxicity, vptree


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_html_extraction": html_extract.op2_html_extraction,
        "op3_nearest_neighbours": vptree.op3_nearest_neighbours,
        "op4_packing": packing.op4_packing,
        "op5_simhash": simhash.op5_simhash,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_bpe_round_trip": bpe.op7_bpe_round_trip,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_token_files": tokenfile.op10_token_files,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": licenses.SQL, "op8_quality_rules": quality.SQL}
