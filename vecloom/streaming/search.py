"""Search of a stream of queries: each micro-batch meets the index, which does not change meanwhile."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..index import VectorIndex
from ..plans.scratch import cut


def percentiles(seconds: list[float], shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> tuple[float, ...]:
    """Interpolated percentiles of latencies; NaN of none."""
    return tuple(float(x) for x in np.quantile(seconds, shares)) if seconds else tuple(float("nan") for _ in shares)


class Latencies(StreamingQueryListener):
    """Of every micro-batch that had queries, its number, how many there were, and the seconds until they were answered.

    ``spark.streams.addListener(Latencies())`` before the stream starts; all streams of the session are heard.
    """

    def __init__(self) -> None:
        self.batches: list[tuple[int, int, float]] = []

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self.batches.append((p.batchId, p.numInputRows, p.batchDuration / 1000))

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def percentiles(self, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> tuple[float, ...]:
        return percentiles([s for _, _, s in self.batches], shares)


def search_stream(queries: DataFrame, index: VectorIndex, k: int, ef: int, out: str, checkpoint: str, mode: str | None = None, **trigger) -> StreamingQuery:
    """Answer streaming queries (qid, qv) into Parquet under ``out``, a folder ``batch=n`` a micro-batch.

    A micro-batch that is run again after a failure overwrites its own folder, so every query is answered
    once. A qid must not come twice in a micro-batch. ``trigger`` is that of writeStream; by default the
    stream ends when what is there is answered.
    """
    def answer(batch: DataFrame, n: int) -> None:
        index.search(cut(batch.select("qid", "qv")), k, ef, mode).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={n}")

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
