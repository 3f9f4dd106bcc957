"""Intermediate tables in the folder that the driver and all executors share."""

import uuid

#: Shuffle files go as soon as the query that made them ends, instead of when the driver's garbage is collected.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark) -> str:
    """spark.checkpoint.dir of the session; a plain local master may do with its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    return folder.rstrip("/")


def stash(df):
    """Write a table into the shared folder and read it back: the lineage ends there, and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/genespark-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    old = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")  # what was written is read from now on, so nothing asks for these files again
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEAN) if old is None else conf.set(_CLEAN, old)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def release(*tables):
    """Empty stashed tables once what was made of them is written itself."""
    for t in tables:
        t.sparkSession.createDataFrame([], t.schema).write.mode("overwrite").parquet(t.stashed_at)
