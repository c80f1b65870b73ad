"""A selection log over a stream of candidates: each micro-batch's rounds are selected and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.selection import select_clients


def write_selection_log(candidates: DataFrame, path: str, checkpoint: str, method: str = "CB-Score", keys: list[str] | None = None, beta: float = 0.4, support: dict[str, int] | None = None, **trigger) -> StreamingQuery:
    """Start a query that appends the selected clients of each batch's groups as Parquet.

    A group (round) must arrive whole in one batch, as files of whole rounds do. Each
    batch overwrites its own ``batch`` partition, so a batch that is run again after
    a failure leaves no duplicates.
    """
    keys = keys or ["round"]

    def append(batch: DataFrame, number: int) -> None:
        chosen = select_clients(batch, method, keys, beta, support)
        chosen.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return candidates.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
