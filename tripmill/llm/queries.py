"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tripmill.llm import chat, dart, extraction, forest, hardneg, langid, licenses, linedup, mixing, outliers, packing, quality, repair
from tripmill.llm.common import table


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def reachable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver does (on a cluster it is shipped or
    installed, README), and have texts sent to them a few megabytes at a time, unless the session asks for less."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    if int(spark.conf.get(ARROW_BYTES).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def over(name: str, build: Callable[..., DataFrame], *more: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        reachable(spark)
        return build(*(table(spark, sf_dir, each) for each in (name, *more)))

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": over("documents", langid.language_query),
    "op2_harmonic_packing": over("documents", packing.pack),
    "op3_quality_ranking": over("documents", quality.quality_query, "labels"),
    "op4_entropy_mixing": over("documents", mixing.mixing_query),
    "op5_chat_trees": over("conversations", chat.chat_query),
    "op6_license_digests": over("documents", licenses.scan),
    "op7_dart_near_dedup": over("documents", dart.classes),
    "op8_outlier_rules": over("documents", outliers.judged),
    "op9_forest_near_dedup": over("embeddings", forest.near_duplicates),
    "op10_page_text": over("pages", extraction.extract_pages),
    "op11_hard_negatives": over("embeddings", hardneg.mining_query),
    "op12_line_runs": over("documents", linedup.line_query),
    "op13_suffix_repair": over("conversations", repair.repair_query),
}
ORACLE: dict[str, str] = {
    "op5_chat_trees": chat.ORACLE_SQL,
    "op6_license_digests": licenses.oracle_sql(),
    "op11_hard_negatives": hardneg.ORACLE_SQL,
    "op12_line_runs": linedup.ORACLE_SQL,
    "op13_suffix_repair": repair.ORACLE_SQL,
}
