"""What streams report of their batches, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from lodewright.operators.staging import hadoop_path

PROGRESS = "event string, query string, name string, batch long, at string, rows long, rows_per_second double, batch_ms long, error string"


class ProgressTable(StreamingQueryListener):
    """Writes a small file for each start, batch and end of the session's streams; ``read`` gives them as a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, 0
        spark.streams.addListener(self)

    def _put(self, **fields) -> None:
        import json
        import uuid

        self.files += 1
        text = json.dumps({k: v for k, v in fields.items() if v is not None})
        where, files = hadoop_path(self.spark, f"{self.path}/{fields['query']}/{self.files:09d}-{uuid.uuid4().hex}.json")
        out = files.create(where)
        out.write(bytearray(text.encode()))
        out.close()

    def onQueryStarted(self, event) -> None:
        self._put(event="started", query=str(event.id), name=event.name, at=event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._put(event="batch", query=str(p.id), name=p.name, batch=p.batchId, at=p.timestamp, rows=p.numInputRows, rows_per_second=p.processedRowsPerSecond, batch_ms=p.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._put(event="ended", query=str(event.id), error=event.exception)

    def stop(self) -> None:
        self.spark.streams.removeListener(self)

    def read(self) -> DataFrame:
        """One row per event."""
        return self.spark.read.schema(PROGRESS).option("recursiveFileLookup", "true").json(self.path)
