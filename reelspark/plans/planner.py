"""The execution planner, detection topology and memory profile as expressions over option columns.

Every function takes a DataFrame of option rows and adds its decisions, so one call plans a whole grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIB = 1024 * 1024
#: batch sizes that auto-tuning considers (fixed values)
CANDIDATES = (1, 2, 3, 4, 6, 8)
BATCH_OVERHEAD = 16 * MIB
LEAST_RESERVE = 512 * MIB
REASONS = {
    "off": "auto-tune disabled; preserving single-frame behavior",
    "lanes": "schedule batch exceeds backend batch; running single-frame inference lanes",
    "chosen": "selected by execution planner",
    "unsupported": "parallel inference requested but unsupported by current runtime/resources",
}


def _long(c: Column) -> Column:
    return F.floor(c).cast("long")


def budget(df: DataFrame) -> DataFrame:
    """per_frame_bytes, reserve_bytes and vram_budget_bytes."""
    per_frame = F.col("frame_bytes") + F.col("in_bytes") + F.col("out_bytes") + F.greatest(_long(F.col("frame_bytes") / 4), F.lit(4 * MIB).cast("long"))
    reserve = F.when(F.col("vram_reserve_mb") > 0, F.col("vram_reserve_mb").cast("long") * MIB).otherwise(F.greatest(F.lit(LEAST_RESERVE).cast("long"), _long(F.col("total_vram") * F.lit(0.2))))
    known = F.col("cuda_available") & (F.col("total_vram") > 0)
    limit = F.least(_long(F.col("total_vram") * F.col("vram_budget_ratio")), F.greatest(F.col("free_vram") - F.col("reserve_bytes"), F.lit(0).cast("long")))
    out = df.withColumn("per_frame_bytes", per_frame).withColumn("reserve_bytes", reserve)
    out = out.withColumn("vram_budget_bytes", F.when(known, limit).otherwise(F.lit(0).cast("long")))
    return out.withColumn("vram_budget_bytes", F.when(F.col("vram_budget_bytes") == 0, F.col("per_frame_bytes") * 2).otherwise(F.col("vram_budget_bytes")))


def transfer_fits(n: Column) -> Column:
    """Copies of ``n`` frames within a quarter of their time, at 70 % of the measured rates; unmeasured passes."""
    fps = F.when(F.col("target_fps") > 0, F.col("target_fps")).when(F.col("video_fps") > 0, F.col("video_fps")).otherwise(F.lit(30.0))
    cost = lambda need, rate: F.when(F.col(need), F.col("frame_bytes") * n / (F.col(rate) * 0.7 * 1e9) * 1000 + 0.05).otherwise(F.lit(0.0))
    unmeasured = (F.col("h2d_gbps") <= 0) | (F.col("d2h_gbps") <= 0)
    return unmeasured | (cost("raw_upload", "h2d_gbps") + cost("raw_download", "d2h_gbps") <= F.lit(1000.0) / fps * n * 0.25)


def candidates(df: DataFrame) -> DataFrame:
    """A row for every option row and candidate batch, with both tests."""
    out = budget(df).withColumn("candidate", F.explode(F.array(*map(F.lit, CANDIDATES))))
    fits = F.col("per_frame_bytes") * F.col("candidate") + BATCH_OVERHEAD <= F.col("vram_budget_bytes")
    return out.withColumn("fits_memory", fits).withColumn("fits_transfer", transfer_fits(F.col("candidate")))


def plan(df: DataFrame) -> DataFrame:
    """``df`` with the plan's columns. Candidates that fail are skipped; the last that passes is taken."""
    out = budget(df)
    passing = [F.when((F.col("per_frame_bytes") * n + BATCH_OVERHEAD <= F.col("vram_budget_bytes")) & transfer_fits(F.lit(n)), F.lit(n)) for n in CANDIDATES]
    manual = F.col("batch_size") > 0
    best = F.when(manual, F.col("batch_size")).when(F.col("auto_tune"), F.coalesce(F.greatest(*passing), F.lit(1))).otherwise(F.lit(1))
    out = out.withColumn("schedule_batch", best)
    out = out.withColumn("backend_batch", F.when(F.col("true_batch") & (F.col("max_batch") > 1), F.least("schedule_batch", "max_batch")).otherwise(F.lit(1)))
    out = out.withColumn("inflight", F.when(F.col("inflight_batches") > 0, F.col("inflight_batches")).when(F.col("auto_tune") & (F.col("vram_budget_bytes") >= F.col("per_frame_bytes") * F.col("schedule_batch") * 4), 2).otherwise(1))
    out = out.withColumn("active_frames", F.col("schedule_batch") * F.col("inflight"))
    out = out.withColumn("upload_batch", F.when(F.col("raw_upload"), F.col("schedule_batch")).otherwise(0)).withColumn("download_batch", F.when(F.col("raw_download"), F.col("schedule_batch")).otherwise(0))
    out = out.withColumn("estimated_bytes", F.col("per_frame_bytes") * F.col("schedule_batch") + BATCH_OVERHEAD).withColumn("unused_bytes", F.greatest(F.col("vram_budget_bytes") - F.col("estimated_bytes"), F.lit(0).cast("long")))
    out = out.withColumn("transfer_batching", (F.col("raw_upload") | F.col("raw_download")) & (F.col("schedule_batch") > 1))
    out = out.withColumn("overlap", (F.col("overlap_mode") == "on") | ((F.col("overlap_mode") == "auto") & F.col("auto_tune") & (F.col("active_frames") > 1) & (F.col("async_engines") > 0)))
    most = F.when(~F.col("concurrent_kernels") & (F.col("parallel_mode") == "auto"), 1).otherwise(F.greatest(F.col("max_contexts"), F.lit(1)))
    wanted = F.when(F.col("manual_contexts") > 0, F.col("manual_contexts")).when(F.col("schedule_batch") > 1, F.col("schedule_batch")).otherwise(F.col("inflight"))
    contexts = F.when((F.col("parallel_mode") != "off") & F.col("parallel_contexts"), F.greatest(F.least(wanted, most, F.col("active_frames")), F.lit(1))).otherwise(F.lit(1))
    out = out.withColumn("contexts", contexts).withColumn("parallel", F.col("contexts") > 1)
    reason = (
        F.when((F.col("parallel_mode") == "on") & ~F.col("parallel"), REASONS["unsupported"]).when(~F.col("auto_tune") & ~manual, REASONS["off"])
        .when(~F.col("true_batch") & (F.col("schedule_batch") > 1), REASONS["lanes"]).otherwise(REASONS["chosen"])
    )
    mode = F.when(F.col("parallel"), 3).when(F.col("overlap"), 2).when(F.col("transfer_batching"), 1).otherwise(0)
    return out.withColumn("reason", reason).withColumn("execution_mode", mode)


def async_override(df: DataFrame, lanes: Column) -> DataFrame:
    """The plan on the asynchronous path: lanes no more than the backend has and frames are active."""
    n = F.greatest(F.least(F.col("contexts"), lanes, F.col("active_frames")), F.lit(1))
    error = F.when((F.col("contexts") > lanes) & (F.col("parallel_mode") == "on"), F.format_string("requested %d async inference lanes but backend exposes only %d", F.col("contexts"), lanes))
    return df.withColumn("lane_error", error).withColumn("contexts", n).withColumn("parallel", n > 1).withColumn("execution_mode", F.when(n > 1, 3).when(F.col("overlap"), 2).otherwise(F.col("execution_mode")))


def blocking_override(df: DataFrame) -> DataFrame:
    """Workers of the blocking path: no more than there are batches in flight."""
    return df.withColumn("workers", F.greatest(F.least(F.col("contexts"), F.col("inflight")), F.lit(1)))


def apply_contexts(df: DataFrame, supported: Column) -> DataFrame:
    """One context where the engine takes no more, an error if they were asked for."""
    short = (F.col("contexts") > 1) & (supported < F.col("contexts"))
    return df.withColumn("context_error", short & (F.col("parallel_mode") == "on")).withColumn("contexts", F.when(short, 1).otherwise(F.col("contexts")))


def topology(df: DataFrame) -> DataFrame:
    """frame_source, inference_device, output_mode, bridges and ``error`` of (decoder, backend_device, draw_boxes, encoder, runtime)."""
    out = df.withColumn("frame_source", F.when(F.col("decoder") == "nvdec", "cuda_nv12").otherwise("cpu_nv12")).withColumn("inference_device", F.when(F.col("backend_device") == "cpu", "cpu").otherwise("cuda"))
    out = out.withColumn("output_mode", F.when(~F.col("draw_boxes"), "csv_only").when(F.col("encoder") == "h264_nvenc", "cuda_annotated").otherwise("cpu_annotated"))
    host, cuda = F.col("frame_source") == "cpu_nv12", F.col("inference_device") == "cuda"
    error = (
        F.when(F.col("output_mode") == "cpu_annotated", "CPU annotated detection output is not implemented").when((F.col("output_mode") == "cuda_annotated") & (host | ~cuda), "CUDA annotated detection requires nvdec, cuda and h264_nvenc")
        .when((F.col("runtime") == "tensorrt") & ~cuda, "TensorRT runtime does not support CPU inference").otherwise("")
    )
    return out.withColumn("requires_raw_upload", host & cuda).withColumn("requires_raw_download", ~host & ~cuda).withColumn("error", error)


def memory_profile(df: DataFrame) -> DataFrame:
    """Slots, threads, workers and pools of a filter run; a budget that is too small leaves one slot and one worker."""
    low = (F.col("profile") == "low") | ((F.col("profile") == "auto") & F.col("lossless"))
    cpu = F.col("mode") == "cpu"
    out = df.withColumn("slots", F.when(low, F.least("frame_slots", F.lit(1))).otherwise(F.col("frame_slots")))
    for c in ("decoder_threads", "encoder_threads"):
        out = out.withColumn(c, F.when(low, F.least(c, F.lit(2))).otherwise(F.col(c)))
    workers = F.when(low & cpu, F.least("processor_workers", F.lit(1))).when(~low & (F.col("profile") == "balanced") & cpu, F.least("processor_workers", F.lit(2))).otherwise(F.col("processor_workers"))
    out = out.withColumn("workers", F.when(cpu, F.greatest(workers, F.lit(1))).otherwise(F.lit(1)))
    need = lambda s, w: 2 * (s + w + 1).cast("long") * F.col("frame_bytes")
    limit = F.col("budget_mb").cast("long") * MIB
    limited = (F.col("budget_mb") > 0) & (F.col("frame_bytes") > 0)
    shrunk = limited & (need(F.col("slots"), F.col("workers")) > limit) & (F.col("profile") != "manual")
    out = out.withColumn("shrunk", shrunk).withColumn("slots", F.when(F.col("shrunk"), 1).otherwise(F.col("slots"))).withColumn("workers", F.when(F.col("shrunk"), 1).otherwise(F.col("workers")))
    out = out.withColumn("pool_frames", F.col("slots") + F.col("workers") + 1).withColumn("pool_bytes", need(F.col("slots"), F.col("workers")))
    return out.withColumn("over_budget", limited & (F.col("pool_bytes") > limit))


def frame_size(width: Column, height: Column, fmt: Column) -> Column:
    """Bytes of a frame; 0 for a size or format that is not valid."""
    w, h = width.cast("long"), height.cast("long")
    size = F.when(fmt == "rgb24", 3 * w * h).when(fmt == "gray8", w * h).when((fmt == "nv12") & (w % 2 == 0) & (h % 2 == 0), F.floor(w * h * 3 / 2)).otherwise(F.lit(0))
    return F.when((w > 0) & (h > 0), size).otherwise(F.lit(0)).cast("long")


def frame_stride(width: Column, fmt: Column) -> Column:
    w = width.cast("long")
    return F.when(w > 0, F.when(fmt == "rgb24", 3 * w).when(fmt.isin("gray8", "nv12"), w).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("long")


def profile_bytes(width: Column, height: Column, fmt: Column) -> Column:
    """Bytes as the video profile counts them: no test for even sizes."""
    w, h = width.cast("long"), height.cast("long")
    return F.when(fmt == "rgb24", 3 * w * h).when(fmt == "nv12", F.floor(w * h * 3 / 2)).when(fmt == "gray8", w * h).otherwise(F.lit(0)).cast("long")


def runtime_of(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike(r"\.(engine|plan)$"), "tensorrt").when(p.rlike(r"\.onnx$"), "onnxruntime").when(p.rlike(r"\.(pt|ts|torchscript)$"), "torchscript").otherwise("auto")


def validate_model(path: Column, runtime: Column) -> Column:
    found = runtime_of(path)
    return (
        F.when(path.isNull() | (path == ""), "model path is empty").when(found == "auto", "unsupported model extension. Supported: .engine, .plan, .onnx, .pt, .ts, .torchscript")
        .when((runtime != "auto") & (runtime != found), F.concat(F.lit("model extension selects "), found, F.lit(" but --runtime is "), runtime)).otherwise("")
    )


#: runtime, cuda, cpu, gpu I/O, true batch, several contexts; as the registry describes a build that has it
BACKENDS = (("tensorrt", True, False, True, False, True), ("onnxruntime", True, True, True, True, False), ("torchscript", True, True, True, True, False))


def registry(spark, compiled: tuple[str, ...] = ()) -> DataFrame:
    """A row a runtime; a runtime that is not compiled in has no capability."""
    rows = [(r, r in compiled, *[bool(f and r in compiled) for f in flags], "linked" if r in compiled else "not compiled") for r, *flags in BACKENDS]
    return spark.createDataFrame(rows, "runtime string, compiled boolean, cuda_available boolean, cpu_available boolean, gpu_io_available boolean, true_batch boolean, multi_context boolean, version string")


#: fixed values: what is said when the hardware decoder fails
FALLBACK = {
    "annotated": "NVDEC CUDA detection path failed and annotated output requires the GPU-resident path; rerun without --draw-boxes for CSV-only CPU fallback",
    "cuda": "NVDEC CUDA detection path failed; falling back to CPU decoder while keeping backend-device=cuda",
    "cpu": "NVDEC CPU-inference bridge failed; falling back to CPU decoder while keeping backend-device=cpu",
}


def decoder_fallback(df: DataFrame) -> DataFrame:
    """``path`` (cpu, hardware, cpu_fallback or failed) and ``message`` of a run of (decoder, backend_device, draw_boxes, decoder_fallback, hardware_ok).

    A hardware path that fails falls back to the decoder on the CPU unless that is switched off, or boxes are
    drawn on the device.
    """
    host, cuda = F.col("decoder") == "cpu", F.col("backend_device") == "cuda"
    stop = F.col("decoder_fallback") == "none"
    path = F.when(host, "cpu").when(F.col("hardware_ok"), "hardware").when(stop | (cuda & F.col("draw_boxes")), "failed").otherwise("cpu_fallback")
    out = df.withColumn("path", path)
    tried = ~host & ~F.col("hardware_ok") & ~stop
    message = F.when(tried & cuda & F.col("draw_boxes"), FALLBACK["annotated"]).when(tried & cuda, FALLBACK["cuda"]).when(tried, FALLBACK["cpu"]).otherwise("")
    return out.withColumn("message", message)


def _yes(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")


def backend_lines(backends: DataFrame) -> DataFrame:
    """(runtime, lines): the listing of each registry row."""
    facts = {"compiled": "compiled", "available": "compiled", "cuda": "cuda_available", "cpu": "cpu_available", "gpu_io": "gpu_io_available", "true_batch": "true_batch", "multi_context": "multi_context"}
    lines = [F.concat(F.col("runtime"), F.lit(":")), *[F.concat(F.lit(f"  {k}: "), _yes(F.col(c))) for k, c in facts.items()], F.concat(F.lit("  version: "), F.col("version"))]
    return backends.select("runtime", F.array(*lines).alias("lines"))


def model_info(models: DataFrame, backends: DataFrame) -> DataFrame:
    """(path, asked, lines): what is known of a model before it is run, of (path, asked, device, labels)."""
    b = F.broadcast(backends.select(F.col("runtime").alias("selected"), "compiled", "gpu_io_available"))  # three rows
    found = runtime_of(F.col("path"))
    df = models.withColumn("selected", F.when(F.col("asked") == "auto", found).otherwise(F.col("asked"))).withColumn("problem", validate_model(F.col("path"), F.col("asked"))).join(b, "selected", "left")
    fmt = F.when(found == "tensorrt", "engine").when(found == "onnxruntime", "onnx").when(found == "torchscript", "torchscript").otherwise("unknown")
    line = lambda k, c: F.concat(F.lit(f"  {k}: "), c)
    head = [F.lit("Model info:"), line("model_path", F.col("path")), line("detected_format", fmt), line("selected_runtime", F.col("selected")), line("backend", F.when(F.col("selected") == "torchscript", "libtorch").otherwise(F.col("selected"))), line("backend_device", F.col("device")), line("model_adapter", F.lit("yolov5 (auto default)")), line("labels_path", F.col("labels"))]
    bad = F.array(*head, F.lit("  valid: no"), line("warning", F.col("problem")))
    good = F.array(*head, F.lit("  valid: yes"), line("backend_compiled", _yes(F.col("compiled"))), line("backend_available", _yes(F.col("compiled"))), line("gpu_resident_possible", _yes(F.col("gpu_io_available") & (F.col("device") == "cuda"))))
    return df.select("path", "asked", F.when(F.col("problem") != "", bad).otherwise(good).alias("lines"))


def hardware_lines(profiles: DataFrame) -> DataFrame:
    """(name, lines): a supplied hardware profile as text."""
    gib = lambda c: F.format_string("%.2f GiB", F.col(c) / F.lit(float(1 << 30)))
    facts = [F.concat(F.lit("total_vram: "), gib("total_vram")), F.concat(F.lit("free_vram: "), gib("free_vram")), F.concat(F.lit("async_engines: "), F.col("async_engines").cast("string")), F.concat(F.lit("concurrent_kernels: "), _yes(F.col("concurrent_kernels"))), F.concat(F.lit("copy GB/s: "), F.format_string("%.2f / %.2f", "h2d_gbps", "d2h_gbps"))]
    return profiles.select("name", F.array(*facts).alias("lines"))
