"""Sessions with the settings that the engine relies on."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def connect(master: str | None = None, app: str = "demandlens", store: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; settings override them (dots written as two underscores).

    With a store folder, tables and their catalog lie there and outlast the
    session; one session at a time may use it.  On a cluster with a metastore
    of its own, leave store out.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}
    if store:
        base = Path(store).resolve()
        conf |= {"spark.sql.warehouse.dir": str(base / "tables"), "spark.hadoop.javax.jdo.option.ConnectionURL": f"jdbc:derby:;databaseName={base / 'catalog'};create=true", "spark.hadoop.datanucleus.schema.autoCreateAll": "true", "spark.hadoop.hive.metastore.schema.verification": "false"}
        builder = builder.enableHiveSupport()
    return builder.config(map=conf).getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
