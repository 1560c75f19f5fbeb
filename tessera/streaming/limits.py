"""Keyed state as Structured Streaming: window limits, first writes, latest states, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.session import shared_folder


#: Groups of keys of a day that share a state: a call of Python for each key and day would cost more than its rows.
GROUPS = 1024


def window_limit(events: DataFrame, limit: int, key: str = "user_id", order: str = "event_id", amount: str = "amount", late: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """Allowed or refused for each call of a key and day: allowed while the day's amount fits; refused calls use nothing.

    Calls of a trigger are taken in order. The keys of a day are dealt into ``groups`` by their hash (calls without a key are one of their own); a
    group's state is what each of its keys has used. A day's state is dropped when the watermark has passed its end.
    """
    days = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("day", F.date_trunc("day", "ts"))

    def step(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values([order])
        keys = [-1] * len(rows) if key_[0] < 0 else rows["key"].astype("int64").tolist()
        allowed, upto = [], []
        for k, n in zip(keys, rows["amount"].tolist()):
            before = used.get(k, 0)
            allowed.append(before + n <= limit)
            used[k] = before + int(n) if allowed[-1] else before
            upto.append(used[k])
        state.update((list(used), list(used.values())))
        state.setTimeoutTimestamp(max(int(pd.Timestamp(key_[1]).value // 1_000_000) + 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [None] * len(rows) if key_[0] < 0 else keys, "day": key_[1], "call": rows[order].to_numpy(), "allowed": allowed, "used": upto})

    group = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(groups))).cast("int")
    return (
        days.select(F.col(key).cast("long").alias("key"), "day", "ts", order, F.col(amount).cast("long").alias("amount")).withColumn("of", group)
        .groupBy("of", "day")
        .applyInPandasWithState(step, "key long, day timestamp, call long, allowed boolean, used long", "keys array<long>, used array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    )


def first_writes(events: DataFrame, keys: list[str], late: str = "31 days") -> DataFrame:
    """The first event of each key; repeats within the watermark are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of each type and window, final once the watermark has passed the window."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def latest_state(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The last event of each key by (ts, event_id), updated as newer ones come; older ones that come late lose."""
    newest = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(key).agg(newest).select(key, "x.event_id", "x.event_type")


def run_once(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over what is there and return the rows, as Parquet in ``folder`` (the shared one), where its state is too.

    Complete mode gives a row for each key again with every trigger: each trigger's rows are a table of their own, and those of the last are returned.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/{name}-state")
    if mode == "append":
        query = writer.format("parquet").start(f"{folder}/{name}")
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/{name}")
    written = []

    def put(rows: DataFrame, trigger: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}-{trigger}")
        written.append(f"{folder}/{name}-{trigger}")

    query = writer.foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(written[-1]) if written else spark.createDataFrame([], stream.schema)
