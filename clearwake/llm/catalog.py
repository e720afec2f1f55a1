"""The registered queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clearwake.llm import decontamination, hard_negatives, importance, jaccard_join, lexical_search, license_scan, packing, quality_rules, secret_scan, sharding, toxicity, url_filter, warc
from clearwake.session import configure


def _configured(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(configure(spark), sf_dir)


QUERIES = {
    "op1_jaccard_join": _configured(jaccard_join.query),
    "op2_quality_rules": _configured(quality_rules.query),
    "op3_secret_scan": _configured(secret_scan.query),
    "op4_sharding": _configured(sharding.query),
    "op5_quality_classifier": _configured(importance.query),
    "op6_warc": _configured(warc.query),
    "op7_license_scan": _configured(license_scan.query),
    "op8_decontamination": _configured(decontamination.query),
    "op9_url_filter": _configured(url_filter.query),
    "op10_packing": _configured(packing.query),
    "op11_lexical_search": _configured(lexical_search.query),
    "op12_hard_negatives": _configured(hard_negatives.query),
    "op13_toxicity": _configured(toxicity.query),
}

ORACLES = {
    "op6_warc": warc.SQL.strip(),
    "op2_quality_rules": quality_rules.SQL.strip(),
    "op7_license_scan": license_scan.SQL.strip(),
    "op8_decontamination": decontamination.SQL.strip(),
    "op9_url_filter": url_filter.SQL.strip(),
    "op11_lexical_search": lexical_search.SQL.strip(),
    "op12_hard_negatives": hard_negatives.SQL.strip(),
}
