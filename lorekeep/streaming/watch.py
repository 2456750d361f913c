"""Keeping the tables current from streams of files and of queue events.

Micro-batches of one query never overlap, and what arrives while one runs waits for the next: that is the debouncing of a watcher.
Where the quiet time itself matters, `debounced` ends a burst as many seconds after its last event. File streams
don't see deletions: each batch compares the listing of the files (no contents) with the page table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import file_name, layer
from ..operators.queue import MOST_RETRIES
from ..sources import kb_files

QUIET = "3 seconds"
FILE = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())]
)


def is_watched(id_):
    """Files of the layers but for what the engine writes itself: index pages and the log. Converted files are watched."""
    return F.regexp_like(id_, F.lit("^(raw|wiki|schema)/")) & ~((file_name(id_) == "index.md") & id_.startswith("wiki/")) & (id_ != "wiki/log.md") & ~F.regexp_like(id_, F.lit(r"/query_log_[^/]*\.jsonl$"))


def changed_files(spark: SparkSession, root: str, most_files: int = 10_000) -> DataFrame:
    """A stream of id, layer, content, mtime of pages as they are created or rewritten, and of files to convert (content null), at most most_files a batch."""
    reader = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most_files)
    found = reader.load(root).select(kb_files.relative(root, F.col("path")).alias("id"), "content", F.unix_timestamp("modificationTime").alias("mtime"))
    page = kb_files.is_page(F.col("id"))
    found = found.where(is_watched(F.col("id")) & (page | kb_files.is_convertible(F.col("id"))))
    return found.select("id", layer(F.col("id")).alias("layer"), F.when(page, F.decode("content", "UTF-8")).alias("content"), "mtime")


def debounced(events: DataFrame, time: str, keys: list[str], quiet: str = QUIET) -> DataFrame:
    """keys, fires_at, n: one row per burst of events, at the end of the quiet time after its last. Works on tables and, with a watermark on `time`, on streams."""
    # events merge into bursts in the tasks that read them, so a key of very many events sends bursts
    events.sparkSession.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", True)
    window = F.session_window(time, quiet)
    return events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("started_at"), F.col("w.end").alias("fires_at"), "n")


def follow(files: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, continuous: str | None = None):
    """Runs handle(batch, number) for each micro-batch of a file stream: all there is now, or every `continuous` interval. The checkpoint is what catches up after a stop."""
    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)).start()


_STATE = "status string, retry_count int, last_error string, queued_at bigint"
_OUT = "path string, status string, retry_count int, last_error string, queued_at bigint, updated_at bigint"


def _step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else None
    rows = pd.concat(list(frames))
    rows["rank"] = rows["event"].map({"enqueued": 0, "started": 1, "failed": 2, "recovered": 3, "done": 4})
    out = None
    for event, error, at in rows.sort_values(["at", "rank"], kind="stable")[["event", "error", "at"]].itertuples(index=False):
        if event == "enqueued":
            now = now or ("pending", 0, None, at)
        elif now is None:
            continue
        elif event == "started" and now[0] == "pending":
            now = ("processing", *now[1:])
        elif event == "recovered" and now[0] == "processing":
            now = ("pending", *now[1:])
        elif event == "failed":
            now = ("failed" if now[1] + 1 >= MOST_RETRIES else "pending", now[1] + 1, error, now[3])
        elif event == "done":
            out, now = ("done", *now[1:], at), None
            continue
        out = (*now, at)
    if now is None:
        if state.exists:
            state.remove()
    else:
        state.update(now)
    if out:
        yield pd.DataFrame([(key[0], *out)], columns=["path", "status", "retry_count", "last_error", "queued_at", "updated_at"])


def queue_states(events: DataFrame) -> DataFrame:
    """The queue as a stream: events (path, event, error, at) in, the new row of each path they touched out; a finished path leaves the state. Events: enqueued, started, failed, recovered, done."""
    return events.groupBy("path").applyInPandasWithState(_step, _OUT, _STATE, "update", "NoTimeout")
