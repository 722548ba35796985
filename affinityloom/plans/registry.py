"""Name -> (Spark plan, SQL text) registry read by the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under ``name``; ``covers`` lists the inventory rows it exercises."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"duplicate query {name}")
        PLANS[name] = plan
        COVERS[name] = covers
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
