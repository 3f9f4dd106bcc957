"""Text input.  Every parser takes a table of lines: ``value`` and, where order matters, ``file, line_no``."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_lines(spark, paths, sep=None):
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    return reader.text(paths).select("value", F.col("_metadata.file_path").alias("file"))


def read_numbered(spark, paths):
    """Lines with their 0-based number in their file, without gathering a file or moving a line.

    Each input split counts its own lines; the offsets of the splits are summed per file.  That table has one row for each
    input split, which the driver lists anyway, so every task gets it.
    """
    raw = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = raw.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # one row per split
    splits = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = raw.join(F.broadcast(splits.drop("_n")), ["file", "_block"])
    return joined.select("value", "file", (F.col("_offset") + F.col("_id") - F.col("_first")).alias("line_no"))


def fields(col="value", sep="\t"):
    return F.split(col, sep)


def checked(condition, value, message):
    """``value`` where the condition holds; any other row fails the job."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))
