"""Geocoding of a stream of queries against a stored database.

The search is stateless, so each micro-batch is a batch of queries; results go to the sink once per batch. The checkpoint
folder of the query makes restarts safe, and a batch that is run again writes the same rows under the same batch number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import forward as W


def geocode_stream(queries: DataFrame, db: W.Database, sink: str, checkpoint: str, n: int = 5, **trigger: object) -> StreamingQuery:
    """Write the best ``n`` suggestions of streamed queries (query_id, text, ...) to parquet below ``sink``, one folder a batch."""
    ready = db.indexed()

    def batch(rows: DataFrame, number: int) -> None:
        found = W.suggest(ready, rows, n=n).withColumn("batch", F.lit(number))
        found.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
