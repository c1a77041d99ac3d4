"""Append-only ledgers as streams: late evidence, duplicates, windows, keyed state with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkweave.sources.scratch import ensure_checkpoint_dir


def ledger(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of parquet ledger files, or a single file, as a stream."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def without_repeats(stream: DataFrame, key: list[str], at: str, lateness: str) -> DataFrame:
    """Each key once, within the lateness bound that keeps the state finite."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, at: str, by: str, width: str, lateness: str) -> DataFrame:
    w = F.window(at, width)
    return stream.withWatermark(at, lateness).groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def valid_evidence(stream: DataFrame, invalidations: DataFrame, key: str, at: str) -> DataFrame:
    """Rows later than the last invalidation of their key (stream-static join)."""
    last = invalidations.groupBy(key).agg(F.max("invalidated_at").alias("__last"))
    return stream.join(last, key, "left").where(F.col("__last").isNull() | (F.col(at) > F.col("__last"))).drop("__last")


def live_reservations(stream: DataFrame, key: str, kind: str, at: str, ttl_seconds: int) -> DataFrame:
    """State per key: reserved by ``reserve``, freed by ``release`` or after ``ttl_seconds`` of event time.

    Emits ``key, live, expires_us`` on every change.
    """
    key_type = dict(stream.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "live": [False], "expires_us": [-1]})
            return
        (until,) = state.get if state.exists else (-1,)
        rows = pd.concat(list(frames)).sort_values(at)
        for what, t in zip(rows[kind], rows[at]):
            until = int(t.value // 1000) + ttl_seconds * 1_000_000 if what == "reserve" else -1
        if until < 0:
            if state.exists:
                state.remove()
        else:
            state.update((until,))
            state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "live": [until >= 0], "expires_us": [until]})

    return (
        stream.select(key, kind, at).withWatermark(at, "0 seconds").groupBy(key)
        .applyInPandasWithState(step, f"`{key}` {key_type}, live boolean, expires_us bigint", "expires_us bigint", "update", GroupStateTimeout.EventTimeTimeout)
    )


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what it wrote (to the shared folder)."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    import uuid

    out = f"{base}/stream-{name}-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data" if mode == "append" else f"{out}/data/*")
