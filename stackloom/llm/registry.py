"""Queries of the operators, over whole tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stackloom.llm import decontaminate, fingerprints, jaccard_join, language_id, license_scan, mixing, periodic_runs, pii, quality, toxicity, url_filter, vector_codes, warc
from stackloom.runtime import ship


def _over(f: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(*(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names))

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": _over(language_id.identify, "documents"),
    "op2_license_scan": _over(license_scan.scan, "documents"),
    "op3_source_mix": _over(lambda d: mixing.mix(d).drop("copies"), "documents"),
    "op4_warc": _over(warc.round_trip, "pages"),
    "op5_fingerprints": _over(fingerprints.fingerprint, "documents"),
    "op6_url_filter": _over(url_filter.judge, "pages"),
    "op7_jaccard_join": _over(jaccard_join.join, "documents"),
    "op8_pii": _over(pii.scan, "documents"),
    "op9_decontamination": _over(decontaminate.leaks, "documents", "benchmark"),
    "op10_quality": _over(quality.classify, "documents", "labels"),
    "op11_vector_codes": _over(vector_codes.compress, "embeddings"),
    "op12_toxicity": _over(toxicity.classify, "documents", "labels"),
    "op13_periodic_runs": _over(periodic_runs.detect, "documents"),
}

ORACLE_SQL: dict[str, str] = {"op2_license_scan": license_scan.scan_sql(), "op4_warc": warc.round_trip_sql(), "op6_url_filter": url_filter.judge_sql(), "op11_vector_codes": vector_codes.compress_sql()}
