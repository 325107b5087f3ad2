"""Streaming over arriving units (SURVEY: T01, T02, T06, T07).

The reference keeps a journal of committed units and starts again after the last whole one. Here a file stream with an
AvailableNow trigger does that: its checkpoint is the journal, a batch is committed as a whole, and a second run takes up what came
since. ``foreachBatch`` writes each batch under its number, so a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    target: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    files_a_batch: int = 1000,
) -> None:
    """Take up all Parquet files that ``source`` has and that no earlier run has committed, then stop."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)

    def commit(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    run = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(commit).start()
    run.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by type and window; later rows than the watermark are dropped. For streams and tables alike."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )


def deferred_references(rows: DataFrame) -> DataFrame:
    """Park references until their target arrives: a stateful operator for streams.

    ``rows``: target (key), ref (null: this row is the target itself). A reference comes out once, with status 1, in the batch in
    which its target is known; those that are left when the stream ends have status 4 by an anti-join with the output.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, waiting = state.get if state.exists else (False, [])
        waiting = list(waiting)
        for b in batches:
            known = known or bool(b["ref"].isna().any())
            waiting += [int(x) for x in b["ref"].dropna()]
        if known:
            state.update((True, []))
            yield pd.DataFrame({"target": [key[0]] * len(waiting), "ref": waiting, "status": [1] * len(waiting)})
        else:
            state.update((False, waiting))

    return rows.groupBy("target").applyInPandasWithState(
        step, "target bigint, ref bigint, status int", "known boolean, waiting array<bigint>", "append", GroupStateTimeout.NoTimeout
    )
