"""Order-dependent operators over frames, without one task that sees all of them.

Running maxima and sums over all frames are computed block by block: within blocks of consecutive frames by a
window, with what the blocks before carry in, of which there is one short row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def running(df: DataFrame, value: str, out: str, kind: str, *, order: str = "frame_index", block: int = BLOCK) -> DataFrame:
    """Running ``kind`` (max or sum) of ``value`` in the order of the unique number ``order``."""
    agg = {"max": F.max, "sum": F.sum}[kind]
    part = F.floor(F.col(order) / block)
    df = df.withColumn("__b", part)
    totals = df.groupBy("__b").agg(agg(value).alias("__t"))
    carried = totals.select("__b", agg("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__c"))  # a row a block
    own = agg(value).over(Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = df.withColumn("__o", own).join(carried, "__b", "left")
    total = F.greatest("__o", "__c") if kind == "max" else F.col("__o") + F.coalesce("__c", F.lit(0))
    return joined.withColumn(out, total).drop("__b", "__o", "__c")


def reorder_wait(frames: DataFrame, done: str) -> DataFrame:
    """``release``: when all earlier frames are done too; ``wait``: how long a frame was held back for them."""
    return running(frames, done, "release", "max").withColumn("wait", F.col("release") - F.col(done))


def batches(frames: DataFrame, size: int) -> DataFrame:
    """Consecutive frames in batches of ``size``, the last one short; ids must be gap-free from 0."""
    total = frames.agg((F.max("frame_index") + 1).alias("__n"))
    out = frames.crossJoin(F.broadcast(total))  # one row
    b = F.floor(F.col("frame_index") / size)
    return out.withColumn("batch_id", b).withColumn("slot", F.col("frame_index") % size).withColumn("valid_frames", F.least(F.lit(size).cast("long"), F.col("__n") - b * size)).drop("__n")


def gap_check(frames: DataFrame) -> DataFrame:
    a = frames.agg(F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.count(F.lit(1)).alias("frames"), F.count_distinct("frame_index").alias("distinct_frames"))
    return a.withColumn("gap_free", (F.col("first_frame") == 0) & (F.col("last_frame") + 1 == F.col("frames")) & (F.col("frames") == F.col("distinct_frames")))


def progress(frames: DataFrame, elapsed_us: str, every: int) -> DataFrame:
    """A row for every ``every`` frames: frames completed, time so far, frames a second."""
    done = F.col("frame_index") + 1
    return running(frames, elapsed_us, "elapsed_us", "sum").filter(done % every == 0).select("frame_index", done.alias("completed"), "elapsed_us", F.round(done * 1e6 / F.col("elapsed_us"), 6).alias("fps"))


def with_pts(frames: DataFrame, *, order: str = "frame_index", block: int = BLOCK) -> DataFrame:
    """``pts``: how many frames come before, in the order of the unique number ``order`` (gaps close up)."""
    return running(frames.withColumn("__one", F.lit(1).cast("long")), "__one", "pts", "sum", order=order, block=block).withColumn("pts", F.col("pts") - 1).drop("__one")


def of_stream(packets: DataFrame, stream: int) -> DataFrame:
    """Packets of one stream of a container; the others are dropped."""
    return packets.filter(F.col("stream_index") == stream)


def timestamp_ms(frame: Column, fps: Column, container: Column | None = None) -> Column:
    """The container's stamp if it is positive, else the frame's place at ``fps``, else 0."""
    at = F.when(fps > 0, frame * 1000.0 / fps).otherwise(F.lit(0.0))
    return at if container is None else F.when(container > 0, container).otherwise(at)


def greedy_lanes(durations: list[float], lanes: int) -> list[int]:
    """The lane each frame gets if the lane free first takes the next one (for reports on one run's schedule)."""
    free = [0.0] * lanes
    out = []
    for d in durations:
        k = free.index(min(free))
        out.append(k)
        free[k] += d
    return out
