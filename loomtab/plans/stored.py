"""Results that plans refer to more than once and that have to be the same rows each time, whatever executors are lost."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the folder that driver and executors share (``spark.checkpoint.dir``; a folder of the driver where it is unset, in local mode)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="shared-"))
    return df.checkpoint(eager=True)
