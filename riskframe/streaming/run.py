"""Running streams: batch sinks, handlers, upserts, model refresh and progress."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from riskframe.session import scratch_folder

Handler = Callable[[DataFrame, int], None]


def tick_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """File stream of a landed folder or of one file (a glob path serves both)."""
    return spark.readStream.schema(schema).parquet(f"{path}*")


def batch_writer(folder: str) -> Handler:
    """Write each micro-batch to its own partition; a repeated batch overwrites itself, so results stay exact."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    return write


def start(stream: DataFrame, handler: Handler, checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Start a stream into a handler: all available data once, or a processing-time trigger."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handler)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all available data and return what it wrote, with its ``batch`` number."""
    spark = stream.sparkSession
    folder = scratch_folder(spark, "stream")
    query = start(stream, batch_writer(f"{folder}/out"), f"{folder}/state", mode)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def newest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final row per key of an update-mode or complete-mode run."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*").drop("batch")


class Handlers:
    """Callbacks per set of symbols, called with the matching rows of every micro-batch."""

    def __init__(self) -> None:
        self._handlers: list[tuple[tuple[str, ...] | None, Handler]] = []

    def register(self, fn: Handler, symbols: Sequence[str] | None = None) -> None:
        self._handlers.append((tuple(symbols) if symbols is not None else None, fn))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        for symbols, fn in self._handlers:
            fn(batch if symbols is None else batch.where(F.col("symbol").isin(*symbols)), batch_id)


def weight_upsert_handler(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], DataFrame]:
    """Merge weight updates by (portfolio, symbol), the latest by time, whatever batch brings it; each batch writes
    a new version, which the next one reads, and the handler returns it."""
    from riskframe.sources.cache import upsert

    def handle(batch: DataFrame, batch_id: int) -> DataFrame:
        new = batch.select("portfolio_id", "symbol", "weight", F.col("ts").alias("write_ts"))
        stored = spark.read.parquet(f"{folder}/version={batch_id - 1}") if batch_id > 0 else new.limit(0)
        upsert(stored, new, ("portfolio_id", "symbol")).write.mode("overwrite").parquet(f"{folder}/version={batch_id}")
        return spark.read.parquet(f"{folder}/version={batch_id}")
    return handle


def risk_alert_handler(spark: SparkSession, limits: DataFrame, folder: str, returns: DataFrame | None = None) -> Handler:
    """Merge every batch of weights into the portfolios held so far, run the limit rules on what is then held, and
    write the alerts of that update to ``folder/batch=n``."""
    from riskframe.operators.monitor import monitor
    merge = weight_upsert_handler(spark, f"{folder.rstrip('/')}-weights")

    def handle(batch: DataFrame, batch_id: int) -> None:
        monitor(merge(batch, batch_id), limits, returns).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    return handle


def refresh_handler(folder: str, after: int, refit: Callable[[DataFrame], DataFrame | None], every: int = 1) -> Handler:
    """Buffer every batch as a table and refit on the last ``after`` batches once that many have come, and then at each
    ``every``-th batch.  The table that
    ``refit`` returns, if any, is the model: it is written as one version for each batch, so a repeated batch overwrites its own version."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        if batch_id + 1 >= after and (batch_id + 1 - after) % every == 0:
            wanted = [f"{folder}/batch={i}" for i in range(batch_id + 1 - after, batch_id + 1)]
            model = refit(batch.sparkSession.read.parquet(*wanted))
            if model is not None:
                model.write.mode("overwrite").parquet(f"{folder.rstrip('/')}-models/version={batch_id}")
    return handle


def latest_model(spark: SparkSession, folder: str) -> DataFrame:
    """The newest model that ``refresh_handler`` wrote for ``folder``, with its ``version``; also after a restart."""
    models = spark.read.parquet(f"{folder.rstrip('/')}-models")
    return models.where(F.col("version") == models.agg(F.max("version")).scalar())


class StatusListener(StreamingQueryListener):
    """Uptime, batches and rows of the running streams from their progress events."""

    def __init__(self) -> None:
        self.status: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.status[str(event.id)] = {"name": event.name, "started": event.timestamp, "batches": 0, "rows": 0, "running": True}

    def onQueryProgress(self, event) -> None:
        entry = self.status.setdefault(str(event.progress.id), {"batches": 0, "rows": 0, "running": True})
        entry["batches"] += 1
        entry["rows"] += event.progress.numInputRows
        entry["last_update"] = event.progress.timestamp

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.status.setdefault(str(event.id), {})["running"] = False
