"""Structured Streaming: ordered emission, running benchmark and live log state.

Backpressure, queues and pools are Spark's micro-batches; what is left to write is the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import parsed
from ..operators.telemetry import running_sums
from ..storage import prepare, shared_folder

MOST_PENDING = 1_000_000


class InOrder(StatefulProcessor):
    """Emits a stream's frames by number without gaps: frame k only after k - 1. Late frames hold back the rest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = StructType([StructField("n", LongType())])
        self.next = handle.getValueState("next", number)
        self.pending = handle.getMapState("pending", number, StructType([StructField("payload", LongType())]))
        self.waiting = handle.getValueState("waiting", number)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        k = self.next.get()[0] if self.next.exists() else 0
        n = self.waiting.get()[0] if self.waiting.exists() else 0
        fresh = pd.concat(list(rows), ignore_index=True)
        got = dict(zip(fresh["frame_index"].tolist(), fresh["payload"].tolist(), strict=True))
        out = []
        while True:
            if k in got:
                out.append((key[0], k, got.pop(k)))
            elif n and self.pending.containsKey((k,)):
                out.append((key[0], k, self.pending.getValue((k,))[0]))
                self.pending.removeKey((k,))
                n -= 1
            else:
                break
            k += 1
        for i, payload in got.items():
            if i < k:
                raise ValueError(f"frame {i} of stream {key[0]} came twice")
            self.pending.updateValue((i,), (payload,))
            n += 1
        if n > MOST_PENDING:
            raise ValueError(f"stream {key[0]} waits for frame {k} with {n} frames held back")
        self.next.update((k,))
        self.waiting.update((n,))
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "frame_index", "payload"])

    def close(self) -> None:
        pass


def in_order(stream: DataFrame) -> DataFrame:
    """(stream_id, frame_index, payload) in order of arrival to the same rows in gap-free order."""
    prepare(stream.sparkSession)
    return stream.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=InOrder(), outputStructType="stream_id int, frame_index bigint, payload bigint", outputMode="Append", timeMode="None")


def batches_in_order(stream: DataFrame, size: int) -> DataFrame:
    """(stream_id, frame_index, payload), one row a batch by its first frame, to batches in gap-free order (``frame_index`` counts batches)."""
    return in_order(stream.select("stream_id", F.floor(F.col("frame_index") / size).alias("frame_index"), "payload"))


def running_benchmark(stream: DataFrame, *keys: str, fields: tuple[str, ...]) -> DataFrame:
    """Frames and summed durations so far."""
    return running_sums(stream, *keys, fields=fields)


def live_progress(stream: DataFrame) -> DataFrame:
    """The last progress that any line gave, of a stream of (line_no, text)."""
    p = parsed(stream)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    return p.agg(last("completed").alias("completed"), last("fps").alias("fps"), F.max("line_no").alias("lines"))


def drained(spark: SparkSession, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run over all that is there into files of the shared folder, and read them; nothing comes to the driver.

    In complete mode every micro-batch replaces the whole result.
    """
    base = f"{shared_folder(spark)}/{name}"
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}-state").trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", base)
    else:
        out = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(base))
    out.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(base)
