"""Traffic as a stream: windowed counts, and per-connection state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Everything that a stream holds now, as a table of results. Results only: they are small aggregates."""
    name = f"drained_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def windowed_counts(spark: SparkSession, d: str, width: str = "1 hour") -> DataFrame:
    """hour (epoch second), event_type, n, total of tumbling windows. Late events of any age count, as the file's order decides nothing."""
    epoch = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    rows = event_stream(spark, d).select(F.timestamp_seconds(epoch).alias("at"), "event_type", F.col("value").cast("decimal(18,4)").alias("value"))
    counts = rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return drained(counts.select(F.unix_seconds("w.start").alias("hour"), "event_type", "n", F.col("total").cast("double").alias("total")), "complete")


def connection_state(commands: DataFrame) -> DataFrame:
    """commands(client, line_no, command), a stream -> client, commands, transactions, in_multi after each batch.

    State is a few numbers a connection; a connection's lines of a batch are
    ordered by line number before they are applied.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, done, open_ = state.get if state.exists else (0, 0, False)
        rows = pd.concat(list(frames)).sort_values("line_no")
        for command in rows["command"]:
            n += 1
            if command == "MULTI":
                open_ = True
            elif command in ("EXEC", "DISCARD"):
                done += int(open_)
                open_ = False
        state.update((n, done, open_))
        yield pd.DataFrame({"client": [key[0]], "commands": [n], "transactions": [done], "in_multi": [open_]})

    return commands.groupBy("client").applyInPandasWithState(
        step, "client string, commands long, transactions long, in_multi boolean", "n long, done long, open boolean", "update", GroupStateTimeout.NoTimeout
    )
