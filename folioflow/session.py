"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE is on by default in Spark; it is named here because hot keys in joins rely on it.
# State stays on local disk with a RocksDB store instead of in executor memory.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(
    cores: int = 8, name: str = "folioflow", shared: str | None = None
) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own.

    `shared` is its folder for written intermediates.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    if shared:
        settings["spark.checkpoint.dir"] = shared
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
