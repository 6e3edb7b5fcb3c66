"""Tables that must be the same however often a plan reads them: written once to the folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in ``spark.checkpoint.dir``. Rows, and columns such as a partition's number, stay what they are when they are read
    again, after the loss of an executor too. A folder of its own is made only where none is set and all runs on this machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()
