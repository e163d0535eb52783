"""Live views: results that are made anew when stored rows or parameters change."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def live_view(
    spark: SparkSession,
    folder: str,
    schema,
    plan: Callable[[DataFrame], DataFrame],
    emit: Callable[[DataFrame, int], None],
    checkpoint: str,
    read: Callable[[], DataFrame] | None = None,
):
    """Watches a folder of Parquet files; whenever files come, ``plan`` runs over all that is stored and ``emit`` gets the result.

    What is stored is the folder's files, or what ``read`` gives.  ``plan`` may
    read parameters when it is called, so each emission combines the latest of all.
    """
    stored = read or (lambda: spark.read.schema(schema).parquet(folder))

    def batch(_: DataFrame, number: int) -> None:
        emit(plan(stored()), number)

    arrivals = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_events(events: DataFrame, folder: str) -> None:
    """Adds events to an append-only log, a folder of Parquet files."""
    events.write.mode("append").parquet(folder)


def new_events(spark: SparkSession, folder: str, schema, emit: Callable[[DataFrame, int], None], checkpoint: str):
    """Gives each event of the log to ``emit`` once: what came since the checkpoint's last run."""
    log = spark.readStream.schema(schema).parquet(folder)
    return log.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes(snapshots: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before it with the same keys; the first always stays."""
    by = Window.partitionBy(*keys).orderBy(*order)
    kept = snapshots.withColumn("__old", F.lag(value).over(by)).withColumn("__n", F.row_number().over(by))
    return kept.filter((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("__old"))).drop("__old", "__n")


class _LastValue(StatefulProcessor):
    """Keeps the last value of a key and lets only changes through; a key's rows of a batch are taken in order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        values = [None if pd.isna(v) else v for v in frame["value"]]
        before = [self.last.get()[0] if self.last.exists() else _NOTHING, *values]
        kept = [(int(seq), new) for seq, old, new in zip(frame["seq"], before, values) if old is _NOTHING or old != new]
        if kept:
            self.last.update((kept[-1][1],))
            yield pd.DataFrame({"key": [key[0]] * len(kept), "seq": [seq for seq, _ in kept], "value": [value for _, value in kept]})

    def close(self) -> None:
        pass


_NOTHING = object()
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_changes(stream: DataFrame) -> DataFrame:
    """(key, seq, value) of a stream, without repeats of a key's last value; its state needs the session's ``STORE`` to be ``ROCKS``."""
    rows = stream.select(F.col("key").cast("string"), F.col("seq").cast("long"), F.col("value").cast("string"))
    return rows.groupBy("key").transformWithStateInPandas(_LastValue(), "key string, seq long, value string", "Append", "None")


def follow_changes(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Takes what came to ``source`` (a folder of Parquet files of key, seq, value) since the checkpoint's last run and
    appends its changes to ``target``; a key's last value outlives the run."""
    kept = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        stream = spark.readStream.schema("key string, seq long, value string").parquet(source)
        out = stream_changes(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
        out.trigger(availableNow=True).start(target).awaitTermination()
    finally:
        spark.conf.unset(STORE) if kept is None else spark.conf.set(STORE, kept)


def run_states(events: DataFrame) -> DataFrame:
    """run_id, state, message of runs (run_id, ok, message): Recognizing while ok is null, then Completed or Failed."""
    state = F.when(F.col("ok").isNull(), "Recognizing").when(F.col("ok"), "Completed").otherwise("Failed")
    return events.select("run_id", state.alias("state"), F.when(state == "Failed", F.coalesce("message", F.lit("unknown"))).alias("message"))
