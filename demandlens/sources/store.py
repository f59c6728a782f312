"""Stored tables: clean trips and the zone lookup in the session catalog."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TRIPS, ZONES

TABLES = {"clean_trips": TRIPS, "zone_lookup": ZONES}


def init_schema(spark: SparkSession) -> None:
    """Create the tables that are missing; trips are partitioned by pickup date."""
    for name, schema in TABLES.items():
        if not spark.catalog.tableExists(name):
            nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
            writer = spark.createDataFrame([], nullable).write.format("parquet")
            (writer.partitionBy("pickup_date") if name == "clean_trips" else writer).saveAsTable(name)


@contextmanager
def temporary_view(df: DataFrame, name: str) -> Iterator[str]:
    df.createOrReplaceTempView(name)
    try:
        yield name
    finally:
        df.sparkSession.catalog.dropTempView(name)


def _insert(df: DataFrame, name: str, replace: bool) -> int:
    """Writes in one pass over df; the rows are counted as they go by.  An empty df replaces nothing."""
    spark, schema = df.sparkSession, TABLES[name]
    if required := [f.name for f in schema if not f.nullable and f.name not in df.columns]:
        raise ValueError(f"{name} needs {', '.join(required)}")
    if replace and df.isEmpty():
        return 0
    seen = Observation()
    rows = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    rows.observe(seen, F.count(F.lit(1)).alias("n")).select(*spark.table(name).columns).write.insertInto(name, overwrite=replace)
    return seen.get["n"]


def insert_clean_trips(df: DataFrame, replace: bool = False) -> int:
    """Append (or replace all) rows; absent optional columns become null.  An empty frame changes nothing."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("hive.exec.dynamic.partition.mode", "nonstrict")
    init_schema(spark)
    return _insert(df, "clean_trips", replace)


def insert_zone_lookup(df: DataFrame, replace: bool = True) -> int:
    init_schema(df.sparkSession)
    return _insert(df, "zone_lookup", replace)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def count_rows(spark: SparkSession, name: str) -> int:
    return spark.table(name).count()


def drop_all(spark: SparkSession, tables: list[str] | None = None) -> None:
    for name in tables or list(TABLES):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
