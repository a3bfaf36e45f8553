"""Cutting lineage into files that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder of ``spark.checkpoint.dir`` and read from there, so that losing an executor costs nothing.

    Only a local session without that setting, as in tests, gets a folder of its own; on a cluster this is an error, because
    a folder of one machine is lost with it. Spark deletes the files with their DataFrame if the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` set, which long-running jobs should have.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wayfold"))
    return df.checkpoint(eager=True)
