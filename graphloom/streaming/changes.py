"""Change events as a stream: debounced batches and per-path generations.

Events: path, ts, generation. State is keyed, checkpointed by the query, and survives
restarts; ``apply`` bodies run in ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Quiet time and longest wait of a change set, and stale files per batch.
QUIET_MS, MAX_DELAY_MS, STALE_BATCH = 300, 2_000, 512


def debounce(events: DataFrame, key: str = "root", quiet: str = "300 milliseconds", late: str = "2 seconds") -> DataFrame:
    """Change sets by a session window of event time: key, first, last, n_events, paths."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(key, F.session_window("ts", quiet).alias("w"))
    return grouped.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n_events"), F.array_sort(F.collect_set("path")).alias("paths")).drop("w")


def latest(events: DataFrame) -> DataFrame:
    """Stream of (path, generation): the newest generation of each path whenever it grows."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else -1
        now = max((int(f["generation"].max()) for f in frames), default=before)
        if now > before:
            state.update((now,))
            yield pd.DataFrame({"path": [key[0]], "generation": [now]})

    return events.groupBy("path").applyInPandasWithState(step, "path string, generation long", "generation long", "update", GroupStateTimeout.NoTimeout)


def delivered(pending: list[tuple[int, str]], now: int, quiet: int = QUIET_MS, most: int = MAX_DELAY_MS) -> bool:
    """Whether waiting changes (time, path) are due: quiet long enough, or waiting too long."""
    return bool(pending) and (now - max(t for t, _ in pending) >= quiet or now - min(t for t, _ in pending) >= most)


def backoff_ms(locked: bool) -> int:
    """Wait before a failed update is tried again."""
    return 250 if locked else 10_000


def updates(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``apply`` on each micro-batch of changed paths (one row per path, newest
    generation). Stale dependents are the caller's table; it takes STALE_BATCH per batch."""

    def body(batch: DataFrame, number: int) -> None:
        apply(batch.groupBy("path").agg(F.max("generation").alias("generation")), number)

    return stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def next_batch(queue: DataFrame, stale: DataFrame, limit: int = STALE_BATCH) -> DataFrame:
    """Queued changes, or, when none wait, the first stale files by path."""
    changed = queue.select("path")
    if not changed.isEmpty():
        return changed
    return stale.select("path").orderBy("path").limit(limit)
