"""Progress of streams: rows and rates of each batch, kept by a listener."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps rows done and seconds taken of each stream; eta tells how long a known rest takes at that rate."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.seconds: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        key = str(p.id)
        self.rows[key] = self.rows.get(key, 0) + p.numInputRows
        self.seconds[key] = self.seconds.get(key, 0.0) + p.batchDuration / 1000

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def rate(self, key: str) -> float:
        return self.rows.get(key, 0) / max(self.seconds.get(key, 0.0), 1e-9)

    def eta(self, key: str, rest: int) -> float | None:
        r = self.rate(key)
        return rest / r if r > 0 else None


def watch(spark: SparkSession) -> Progress:
    listener = Progress()
    spark.streams.addListener(listener)
    return listener
