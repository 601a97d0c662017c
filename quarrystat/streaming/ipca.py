"""Incremental PCA over a stream of samples."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from quarrystat.operators.decomposition import IpcaState, ipca_fit

_STATE = "n double, mu array<double>, d array<double>, u array<array<double>>"


def save_state(spark: SparkSession, state: IpcaState, path: str) -> None:
    row = (state.n, state.mu.tolist(), state.d.tolist(), state.u.tolist())
    spark.createDataFrame([row], _STATE).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str, needed: bool = False) -> IpcaState | None:
    """The state at ``path``; None where nothing was learnt yet. A missing path is an
    error if the state is ``needed``."""
    try:
        row = spark.read.schema(_STATE).parquet(path).first()
    except AnalysisException as missing:
        if needed:
            raise RuntimeError(f"the state of the batch before is gone: {path}") from missing
        return None
    if row is None:
        return None
    return IpcaState(np.array(row["u"], float), np.array(row["d"], float),
                     np.array(row["mu"], float), row["n"])


class StreamingPca:
    """``foreachBatch`` target that updates the components batch by batch.

    The state after batch b lies in ``<path>/b``: a replayed batch whose state
    exists is skipped, so every batch counts once.
    """

    def __init__(self, path: str, k: int | None = None, ff: float = 1.0):
        self.path, self.k, self.ff = path.rstrip("/"), k, ff

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = f"{self.path}/{batch_id}"
        if load_state(spark, at) is not None:
            return
        before = load_state(spark, f"{self.path}/{batch_id - 1}", needed=True) if batch_id else None
        batch = batch.select("features").persist()      # read again by every product
        try:
            if batch.isEmpty():
                if before is not None:
                    save_state(spark, before, at)
                else:                              # nothing learnt yet, but the batch is done
                    spark.createDataFrame([], _STATE).write.mode("overwrite").parquet(at)
                return
            save_state(spark, ipca_fit(batch, before, self.ff, self.k), at)
        finally:
            batch.unpersist()

    def latest(self, spark: SparkSession, batch_id: int) -> IpcaState | None:
        return load_state(spark, f"{self.path}/{batch_id}")

    def run(self, stream: DataFrame, checkpoint: str) -> IpcaState | None:
        """Process what the stream offers now and return the last state."""
        q = (stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        if q.lastProgress is None:
            return None
        return self.latest(stream.sparkSession, q.lastProgress["batchId"])
