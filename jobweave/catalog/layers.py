"""Inputs of the registered queries: bronze, silver and gold over one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobweave.operators import gold as G
from jobweave.plans import silver as plan
from jobweave.plans import warehouse
from jobweave.sources import derived


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return derived.table(spark, d, name)


def raw(spark: SparkSession, d: str) -> DataFrame:
    return derived.raw_jobs(spark, d)


def stage(spark: SparkSession, d: str, name: str) -> DataFrame:
    return dict(plan.stages(raw(spark, d), warehouse.OPTIONS))[name]


def silver(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.silver(spark, d)


def gold(spark: SparkSession, d: str) -> DataFrame:
    return G.with_gold_columns(silver(spark, d))


def gold_salary(spark: SparkSession, d: str) -> DataFrame:
    return G.salary_subset(gold(spark, d))


def chart(spark: SparkSession, d: str) -> DataFrame:
    return G.with_chart_columns(silver(spark, d))


def chart_salary(spark: SparkSession, d: str) -> DataFrame:
    return G.trimmed_salary_subset(chart(spark, d))
