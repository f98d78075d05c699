"""Queries over the whole test tables for the text operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.llm import bpe, mixing, mojibake, truncation
from trussline.operators.common import key_of, load

Query = Callable[[SparkSession, str], DataFrame]


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names of tasks, WBS nodes and calendars: tab, rec_id, name."""
    one = lambda tab, key, name: load(spark, d, tab).select(F.lit(tab).alias("tab"), key_of(key).alias("rec_id"), F.col(name).alias("name"))
    return one("task", "task_id", "task_name").unionByName(one("projwbs", "wbs_id", "wbs_name")).unionByName(one("calendar", "clndr_id", "clndr_name"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(_names(spark, d)).select("tab", "rec_id").distinct()


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(_names(spark, d)).groupBy("tab", "rec_id").agg(F.min_by("name", F.struct("name")).alias("name"), F.min("restored").alias("restored"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(load(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids."""
    ids = bpe.encode(load(spark, d, "documents").select("doc_id", "text"))
    return ids.select("doc_id", bpe.decoded(F.col("ids")).alias("text"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(mixing.sized(load(spark, d, "documents")), load(spark, d, "mix_target"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(mixing.sized(load(spark, d, "documents")), load(spark, d, "mix_target"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(load(spark, d, "documents")).where("is_cut").select("doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_shares(load(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p6_found, p6_restored, p7_ids, p7_decoded, p8_mix, p8_shares, p9_found, p9_shares)}

SQL: dict[str, str] = {
    "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
