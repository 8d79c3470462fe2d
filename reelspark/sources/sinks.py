"""Report and detection files with their fixed column orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import csv_rows, with_names

FILTER_COLUMNS = "frame_index decode_ms upload_ms kernel_ms download_ms process_ms encode_ms total_ms".split()
#: the detection report's columns in file order (fixed values)
DETECTION_COLUMNS = (
    "frame_index decode_ms raw_frame_upload_bytes upload_ms preprocess_ms inference_ms backend_inference_ms metadata_download_bytes download_ms postprocess_ms detections_count overlay_ms encode_ms mux_write_ms "
    "total_ms runtime_backend backend_device precision model_format model_adapter input_layout input_dtype output_device video_width video_height video_fps frame_bytes raw_frame_download_bytes schedule_batch_size "
    "backend_batch_size batch_size inflight_batches total_active_frames active_frame_capacity frames_per_upload_batch frames_per_download_batch execution_mode inference_context_count inference_lane_count vram_budget_mb "
    "estimated_batch_mb unused_vram_budget_mb decode_queue_wait_ms inference_queue_wait_ms inference_lane_wait_ms output_reorder_wait_ms metadata_queue_wait_ms encode_queue_wait_ms end_to_end_latency_ms stage_sum_ms"
).split()


def report_rows(timing: DataFrame, columns: list[str] = FILTER_COLUMNS) -> DataFrame:
    """The columns in file order; durations as text of six places, columns that a path does not measure 0."""
    kinds = dict(timing.dtypes)

    def cell(c):
        if c not in kinds:
            return F.lit("0.000000" if c.endswith(("_ms", "_mb", "_fps")) else "0").alias(c)
        return F.format_string("%.6f", F.col(c).cast("double")).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("string").alias(c)

    return timing.select(*map(cell, columns))


def write_report(timing: DataFrame, path: str, columns: list[str] = FILTER_COLUMNS) -> None:
    """Ordered part files by ranges of frames, a header in each; no single task writes all."""
    report_rows(timing.repartitionByRange("frame_index").sortWithinPartitions("frame_index"), columns).write.option("header", True).csv(path)


def write_detections(detections: DataFrame, labels: DataFrame, path: str) -> None:
    rows = csv_rows(with_names(detections.repartitionByRange("frame_index"), labels).sortWithinPartitions("frame_index"))
    rows.write.option("header", True).csv(path)


def write_log(logs: DataFrame, path: str) -> None:
    logs.repartitionByRange("line_no").sortWithinPartitions("line_no").select("text").write.text(path)
