"""Loops whose rounds depend on the data: each round's rows are put away, so that plans don't grow with the rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(rows: DataFrame) -> DataFrame:
    """The same rows, read from a checkpoint in the folder that the session names (spark.checkpoint.dir).

    Where it names none, a session of one machine gets a folder of its own; on a cluster that is an error,
    for a folder of one machine would lose what others write.
    """
    context = rows.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='checkpoints-')}")
    return rows.checkpoint()
