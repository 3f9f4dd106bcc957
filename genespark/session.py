"""Session defaults used by the tests and the benchmark."""

import os

from pyspark.sql import SparkSession


def session(cores=None, shuffle_partitions=None, app="genespark", memory=None, **options):
    """A session with adaptive plans and UTC. Master, shuffle width and memory are the cluster's unless they are given.

    options: further settings, with _ for the dots of their names."""
    cores = cores or os.environ.get("BENCH_CPUS")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cores:
        builder = builder.master(f"local[{cores}]")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    for name, value in options.items():
        builder = builder.config(name.replace("_", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
