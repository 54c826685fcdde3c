"""The operators' queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, exact, lm, minhash, mixing, packing, repeats, runs, sharding, topk, toxicity, urls
from .common import table


def op1_minhash(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, d, "documents")).drop("c1", "c2")


def op2_topk(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_repeats(spark: SparkSession, d: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, d, "documents"), passage_words=repeats.WORDS)


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxic_rows(table(spark, d, "documents"), table(spark, d, "labels"))


def op5_language_model(spark: SparkSession, d: str) -> DataFrame:
    return lm.score(table(spark, d, "documents"))


def op6_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"))


def op7_urls(spark: SparkSession, d: str) -> DataFrame:
    return urls.judge(table(spark, d, "pages"))


def op8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def op9_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard(table(spark, d, "documents"))


def op10_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact.exact_dedup(table(spark, d, "documents"))


def op11_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_rows(runs.periodic_runs(runs.with_periods(table(spark, d, "documents"))))


def op12_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_documents(table(spark, d, "documents"), table(spark, d, "labels"))


def op13_chat_format(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_chats(chat.fold_log(chat.as_log(turns.unionByName(extra)))))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_topk, op3_repeats, op4_toxicity, op5_language_model, op6_mixing, op7_urls, op8_packing, op9_sharding, op10_exact_dedup, op11_periodic_runs, op12_filter_audit, op13_chat_format)}
