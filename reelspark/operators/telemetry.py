"""Derived durations, running and final summaries, and the comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: duration columns that a benchmark sums
SUMMED = ("decode_ms", "upload_ms", "preprocess_ms", "inference_ms", "download_ms", "postprocess_ms", "overlay_ms", "encode_ms", "mux_write_ms", "process_ms", "total_ms")

#: named projections of process_ms and total_ms; the paths differ in what they count
PATHS = {
    "filter": ("process_ms", "decode_ms + process_ms + encode_ms"),
    "cpu_detect": ("upload_ms + preprocess_ms + inference_ms + download_ms + postprocess_ms", "decode_ms + process_ms"),
    "cpu_bridge_detect": ("upload_ms + preprocess_ms + inference_ms + download_ms + bridge_ms + postprocess_ms", "decode_ms + process_ms"),
    "cuda_detect": ("upload_ms + preprocess_ms + inference_ms + download_ms + postprocess_ms + overlay_ms", "decode_ms + process_ms + encode_ms + mux_write_ms"),
    "cuda_async_detect": ("upload_ms + preprocess_ms + inference_ms + download_ms + postprocess_ms + overlay_ms", "decode_ms + process_ms + encode_ms + mux_write_ms"),
}


def with_totals(timing: DataFrame, path: str) -> DataFrame:
    """``timing`` with process_ms and total_ms as the path counts them; the asynchronous one adds stage_sum_ms."""
    process, total = PATHS[path]
    out = timing.withColumn("process_ms", F.expr(process)).withColumn("total_ms", F.expr(total))
    return out.withColumn("stage_sum_ms", F.col("total_ms")) if path == "cuda_async_detect" else out


def ratio(above: Column, below: Column) -> Column:
    """0 unless the divisor is positive."""
    return F.when(below > 0, above / below).otherwise(F.lit(0.0))


def filter_summary(timing: DataFrame, wall_ms: float) -> DataFrame:
    a = timing.agg(F.count(F.lit(1)).alias("frames"), F.sum("total_ms").alias("t"), F.sum("process_ms").alias("p"))
    n = F.col("frames").cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.select(
        "frames", F.round(zero(F.col("t")), 3).alias("total_ms"), F.round(zero(ratio(F.col("t"), n)), 6).alias("avg_total_ms"), F.round(zero(ratio(F.col("p"), n)), 6).alias("avg_process_ms"),
        F.round(zero(ratio(n * 1000, F.col("t"))), 6).alias("processed_fps"), F.round(ratio(n * 1000, F.lit(float(wall_ms))), 6).alias("wall_clock_fps"),
    )


def detection_summary(timing: DataFrame, *keys: str, wall_ms: float = 0.0) -> DataFrame:
    """Averages of all summed durations by ``keys``, and frames a second of the wall clock (0 if it is not known).

    ``avg_stage_sum_ms`` is the mean total, as is customary here.
    """
    n = F.count(F.lit(1))
    means = [F.round(F.sum(c) / n, 6).alias(f"avg_{c}") for c in SUMMED]
    wall = F.round(ratio(n * 1000.0, F.lit(float(wall_ms))), 6).alias("wall_clock_fps")
    return timing.groupBy(*keys).agg(n.alias("frames"), wall, *means, F.round(F.sum("total_ms") / n, 6).alias("avg_stage_sum_ms"), F.round(ratio(n * 1000.0, F.sum("total_ms")), 6).alias("latency_equivalent_fps"))


def matrix_report(timing: DataFrame) -> DataFrame:
    """Frames, total, mean and rate by mode, with the speedup of gpu over cpu beside them, in one pass."""
    by = timing.groupBy("mode").agg(F.count(F.lit(1)).alias("frames"), F.sum("total_ms").alias("t"))
    both = by.agg(F.sum(F.when(F.col("mode") == "cpu", F.col("t"))).alias("c"), F.sum(F.when(F.col("mode") == "gpu", F.col("t"))).alias("g"))
    return by.crossJoin(F.broadcast(both)).select(  # one row
        "mode", "frames", F.round("t", 3).alias("total_time_ms"), F.round(ratio(F.col("t"), F.col("frames").cast("double")), 6).alias("average_ms_per_frame"),
        F.round(ratio(F.col("frames") * 1000.0, F.col("t")), 6).alias("processed_fps"), F.round(F.coalesce(ratio(F.col("c"), F.col("g")), F.lit(0.0)), 6).alias("speedup"),
    )


#: bytes of one detection as the reports count them (fixed value)
DETECTION_BYTES = 40
#: columns of the plan in the detection report, and where the planner has them
PLAN_COLUMNS = {
    "schedule_batch_size": "schedule_batch", "backend_batch_size": "backend_batch", "batch_size": "schedule_batch", "inflight_batches": "inflight", "total_active_frames": "active_frames",
    "active_frame_capacity": "active_frames", "frames_per_upload_batch": "upload_batch", "frames_per_download_batch": "download_batch", "execution_mode": "execution_mode",
    "inference_context_count": "contexts", "inference_lane_count": "contexts",
}


def with_plan(timing: DataFrame, plan: DataFrame) -> DataFrame:
    """Every timing row with the columns of a run's one plan row (``planner.plan``)."""
    mib = lambda c: (F.col(c) / F.lit(1048576.0))
    one = plan.select(*[F.col(c).alias(n) for n, c in PLAN_COLUMNS.items()], mib("vram_budget_bytes").alias("vram_budget_mb"), mib("estimated_bytes").alias("estimated_batch_mb"), mib("unused_bytes").alias("unused_vram_budget_mb"))
    return timing.crossJoin(F.broadcast(one.limit(1)))  # one row


def with_detection_metadata(timing: DataFrame, *, model: str, runtime: str = "auto", device: str = "cuda", precision: str = "fp16", width: int, height: int, fps: float, raw_upload: bool, raw_download: bool) -> DataFrame:
    """Constant columns of the run (runtime, model, video, bytes) and those that follow from ``detections_count``."""
    from ..plans.options import runtime_of

    found = runtime_of(model)
    size = width * height * 3 // 2 if width > 0 and height > 0 else 0
    formats = {"tensorrt": "engine", "onnxruntime": "onnx", "torchscript": "torchscript"}
    count = F.coalesce("detections_count", F.lit(0)).cast("long")
    whole = lambda n: F.lit(n).cast("long")
    return timing.withColumns(
        {
            "runtime_backend": F.lit(found if runtime == "auto" else runtime), "model_format": F.lit(formats.get(found, "unknown")), "model_adapter": F.lit("yolov5"), "backend_device": F.lit(device),
            "input_layout": F.lit("nchw"), "input_dtype": F.lit("fp16" if precision == "fp16" else "fp32"), "output_device": F.lit("metadata_host"), "precision": F.lit(precision),
            "video_width": F.lit(width), "video_height": F.lit(height), "video_fps": F.lit(float(fps)), "frame_bytes": whole(size), "backend_inference_ms": F.col("inference_ms"),
            "raw_frame_upload_bytes": whole(size if raw_upload else 0), "raw_frame_download_bytes": whole(size if raw_download else 0),
            "detections_count": count, "metadata_download_bytes": count * DETECTION_BYTES,
        }
    )


def frame_report(timing: DataFrame, detections: DataFrame) -> DataFrame:
    """Timing rows, one a frame, with how many detections each frame has; counted before they are shuffled."""
    counts = detections.groupBy("frame_index").agg(F.count(F.lit(1)).alias("detections_count"))
    return timing.join(counts, "frame_index", "left").withColumn("detections_count", F.coalesce("detections_count", F.lit(0)).cast("long"))


def detection_rows(frames: DataFrame, detections: DataFrame, timing: DataFrame) -> DataFrame:
    """Each detection beside its frame's stamp and the durations of its frame."""
    return detections.join(frames.select("frame_index", "timestamp_ms"), "frame_index").join(timing, "frame_index")


def running_sums(timing: DataFrame, *keys: str, fields: tuple[str, ...] = SUMMED) -> DataFrame:
    """Frames and the sum of every duration; in batch or, over a stream, so far."""
    grouped = timing.groupBy(*keys)
    return grouped.agg(F.count(F.lit(1)).alias("frames"), *[F.sum(c).alias(c) for c in fields])


def copy_bandwidth(copies: DataFrame, *keys: str) -> DataFrame:
    """Mean GB/s over the copies (bytes, ms) of each of ``keys``; copies that took no time are left out."""
    return copies.filter("ms > 0").groupBy(*keys).agg(F.round(F.avg(F.col("bytes") / F.col("ms") / 1e6), 6).alias("gbps"))


def engine_memory(free_before: Column, free_after: Column) -> Column:
    """What an engine has taken: never under 0."""
    return F.greatest(free_before - free_after, F.lit(0).cast("long"))
