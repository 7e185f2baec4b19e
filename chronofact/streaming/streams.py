"""Structured Streaming: event capture, the injection ledger with its time to live, rolling context.

The ledger's rule is a greedy chain per (session, fact): an event is let through, then others are suppressed for less than TTL
from it, then the next goes through. It is keyed state in a stream and a fold over each key in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronofact.shipping import ship
from chronofact.storage import shared_folder

TTL_MS = 3_600_000
CONTEXT = 8


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder, or of a glob, as a stream."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def capture(events: DataFrame) -> DataFrame:
    """Episodes of raw events; kinds that aren't mapped are left out."""
    kind = F.when(F.col("event_type") == "signup", "session_start").when(F.col("event_type") == "view", "prompt_submitted").when(F.col("event_type") == "click", "tool_call").when(F.col("event_type").isin("purchase", "error"), "tool_result")
    return events.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), kind.alias("event_type"), (F.col("event_type") != "error").alias("success"), F.col("ts").alias("created_at"), F.col("props").alias("payload")).filter("event_type IS NOT NULL")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run over what there is, into Parquet in the shared folder, and read that. State and progress are checkpointed there too."""
    import uuid

    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def chain(times: list[int], last: int | None, ttl: int = TTL_MS) -> tuple[list[bool], int | None]:
    """Which of the sorted times go through, and the last that did."""
    out = []
    for t in times:
        through = last is None or t - last >= ttl
        last = t if through else last
        out.append(through)
    return out, last


def ledger_stream(events: DataFrame, ttl: int = TTL_MS, late: str = "1 hour") -> DataFrame:
    """events: session_id, fact_id, at (event time), at_ms, event_id, at most `late` out of order. With `through`; state is one number a key, kept until the watermark is a `ttl` past it.

    The checkpoint in the shared folder carries the state over restarts and between processes, so none tells a fact twice.
    """
    ship(events.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["at_ms", "event_id"])
        through, last = chain(rows["at_ms"].tolist(), state.get[0] if state.exists else None, ttl)
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last), state.getCurrentWatermarkMs()) + ttl)
        yield pd.DataFrame({"session_id": key[0], "fact_id": key[1], "event_id": rows["event_id"], "through": through})

    dealt = events.withWatermark("at", late).groupBy("session_id", "fact_id")
    return dealt.applyInPandasWithState(step, "session_id string, fact_id string, event_id bigint, through boolean", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def ledger_batch(events: DataFrame, ttl: int = TTL_MS) -> DataFrame:
    """The same over a table."""
    ship(events.sparkSession)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at_ms", "event_id"])
        return rows[["session_id", "fact_id", "event_id"]].assign(through=chain(rows["at_ms"].tolist(), None, ttl)[0])

    return events.groupBy("session_id", "fact_id").applyInPandas(fold, "session_id string, fact_id string, event_id bigint, through boolean")


def last_context_stream(episodes: DataFrame, n: int = CONTEXT) -> DataFrame:
    """After each batch's events of a session, its last n episode ids. State is those ids."""
    ship(episodes.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["created_at", "event_id"])
        ids = (old + [int(x) for x in rows["event_id"]])[-n:]
        state.update((ids,))
        yield pd.DataFrame({"session_id": [key[0]], "ids": [ids]})

    return episodes.groupBy("session_id").applyInPandasWithState(step, "session_id string, ids array<bigint>", "ids array<bigint>", "append", GroupStateTimeout.NoTimeout)
