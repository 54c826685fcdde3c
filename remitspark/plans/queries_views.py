"""KPI view queries over the derived claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views
from .roles import claims, table


def exec_monthly(spark: SparkSession, d: str) -> DataFrame:
    return views.executive_monthly(claims(spark, d, payer=True))


def root_cause(spark: SparkSession, d: str) -> DataFrame:
    return views.denial_root_cause(claims(spark, d))


def root_cause_labelled(spark: SparkSession, d: str) -> DataFrame:
    """The root causes with the display label of their code group; one label a code, so the grain stays."""
    labels = table(spark, d, "orders").groupBy(F.expr("substring(o_orderpriority, 1, 1) as carc_code")).agg(
        F.expr("min(concat(upper(substring(o_orderpriority, 3, 1)), lower(substring(o_orderpriority, 4)))) as category_label")
    )
    return views.denial_root_cause(claims(spark, d), labels)


def ar_aging(spark: SparkSession, d: str) -> DataFrame:
    return views.ar_aging(claims(spark, d))


def payer_perf(spark: SparkSession, d: str) -> DataFrame:
    return views.payer_performance(claims(spark, d, payer=True))


def provider_quality(spark: SparkSession, d: str) -> DataFrame:
    return views.provider_quality(claims(spark, d, payer=True, provider=True))


def heuristic_queue(spark: SparkSession, d: str) -> DataFrame:
    return views.heuristic_queue(claims(spark, d, payer=True, provider=True))


def drift_monthly(spark: SparkSession, d: str) -> DataFrame:
    return views.drift_monthly(claims(spark, d, payer=True))


QUERIES = {
    "exec_monthly": exec_monthly,
    "root_cause": root_cause,
    "root_cause_labelled": root_cause_labelled,
    "ar_aging": ar_aging,
    "payer_perf": payer_perf,
    "provider_quality": provider_quality,
    "heuristic_queue": heuristic_queue,
    "drift_monthly": drift_monthly,
}
