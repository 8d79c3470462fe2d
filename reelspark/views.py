"""Frames, pixels, predictions, labels, timings and logs as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import prepare

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: a vector component as a byte
BYTE = "cast(least(greatest(floor((cast({v} as double) + 0.6D) * 212.5D), 0), 255) as int)"


def gray8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_index, px): 8 x 8 frames as one array of 64 values each; pixel i at x = i % 8, y = i div 8."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("frame_index"), F.expr(f"transform(embedding, v -> {BYTE.format(v='v')})").alias("px"))


def rgb24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_index, px): 4 x 4 frames of three channels, interleaved."""
    return gray8(spark, sf_dir).select("frame_index", F.slice("px", 1, 48).alias("px"))


def nv12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_index, px): 8 x 4 frames, 32 luma values and then 8 interleaved chroma pairs."""
    return rgb24(spark, sf_dir)


def pattern(spark: SparkSession) -> DataFrame:
    """(frame_index, px): the one 17 x 15 test frame with three linear ramps."""
    i = F.col("id").cast("int")
    x, y = i % 17, F.floor(i / 17).cast("int")
    values = F.array(*[(a * x + b * y).bitwiseAND(F.lit(255)) for a, b in ((17, 3), (5, 29), (11, 7))])
    return spark.range(255).select(i.alias("i"), values.alias("v")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])).alias("px")).select(F.lit(0).alias("frame_index"), "px")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of detector output a vector: box centre and size in pixels of a 640 x 640 input, objectness, 25 scores."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    return e.select(
        F.col("label").alias("frame_index"), F.col("vec_id").alias("prediction"), ((at(0) + 0.5) * 640).alias("cx"), ((at(1) + 0.5) * 640).alias("cy"),
        ((F.abs(at(2)) + 0.3) * 640).alias("w"), ((F.abs(at(3)) + 0.3) * 640).alias("h"), (at(4) + 0.5).alias("obj"),
        F.expr("transform(slice(embedding, 6, 25), v -> cast(v as double) + 0.5D)").alias("scores"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("class_id"), F.col("n_name").alias("class_name"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of frames at 25 a second with their decode time, a class and an arrival stamp in microseconds."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("frame_index"), (F.col("event_id") * 1000.0 / 25).alias("timestamp_ms"), F.col("value").alias("decode_ms"), (F.col("user_id") % 25).cast("int").alias("class_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), (F.floor(F.col("value") * 1000)).cast("long").alias("decode_us"), "event_type",
    )


def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timing row a line item; stages without a column of their own are fixed shares of the processing time."""
    t = table(spark, sf_dir, "lineitem")
    process = F.col("l_extendedprice") / 1000
    return t.select(
        F.when(F.col("l_linestatus") == "F", "cpu").otherwise("gpu").alias("mode"),
        F.when(F.col("l_returnflag") == "N", "tensorrt").when(F.col("l_returnflag") == "R", "onnxruntime").otherwise("torchscript").alias("runtime"),
        F.col("l_quantity").alias("decode_ms"), process.alias("process_ms"), (F.col("l_discount") * 100).alias("encode_ms"), (F.col("l_tax") * 100).alias("upload_ms"),
        (process * 0.125).alias("preprocess_ms"), (process * 0.5).alias("inference_ms"), (F.col("l_tax") * 50).alias("download_ms"), (process * 0.25).alias("postprocess_ms"),
        (process * 0.0625).alias("overlay_ms"), (F.col("l_discount") * 25).alias("mux_write_ms"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, text, is_error): progress lines, every 50th an error and every 70th a plan line."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    text = (
        F.when(n % 50 == 7, F.concat(F.lit("[ERROR] frame "), n.cast("string"), F.lit(" failed"))).when(n % 70 == 9, F.concat(F.lit("batch_size: "), (n % 8 + 1).cast("string"))).when(n % 90 == 11, F.lit("[WARN] TensorRT fallback"))
        .otherwise(F.concat(F.lit("progress: completed "), (n + 1).cast("string"), F.lit(" filter frames, wall_clock_fps="), F.format_string("%.2f", F.col("value"))))
    )
    return e.select(n.alias("line_no"), text.alias("text"), (F.col("event_type") == "error").alias("is_error"))


#: The same views for DuckDB, as common table expressions.
SQL = {
    "px": "px as (select vec_id as frame_index, i - 1 as i, least(greatest(floor((embedding[i]::double + 0.6::double) * 212.5::double), 0), 255)::int as p from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings))",
    "pred": "pred as (select label as frame_index, vec_id as prediction, (embedding[1]::double + 0.5) * 640 as cx, (embedding[2]::double + 0.5) * 640 as cy, (abs(embedding[3]::double) + 0.3::double) * 640 as w, (abs(embedding[4]::double) + 0.3::double) * 640 as h, embedding[5]::double + 0.5 as obj, list_transform(embedding[6:30], lambda x: x::double + 0.5) as scores from embeddings)",
    "labels": "lab as (select n_nationkey::int as class_id, n_name as class_name from nation)",
    "frames": "fr as (select event_id as frame_index, event_id * 1000.0::double / 25 as timestamp_ms, value as decode_ms, (user_id % 25)::int as class_id, epoch_us(ts) as ts_us, floor(value * 1000)::bigint as decode_us, event_type from events)",
    "timing": "tm as (select case l_linestatus when 'F' then 'cpu' else 'gpu' end as mode, case l_returnflag when 'N' then 'tensorrt' when 'R' then 'onnxruntime' else 'torchscript' end as runtime, l_quantity as decode_ms, l_extendedprice / 1000 as process_ms, l_discount * 100 as encode_ms, l_tax * 100 as upload_ms, l_extendedprice / 1000 * 0.125 as preprocess_ms, l_extendedprice / 1000 * 0.5 as inference_ms, l_tax * 50 as download_ms, l_extendedprice / 1000 * 0.25 as postprocess_ms, l_extendedprice / 1000 * 0.0625 as overlay_ms, l_discount * 25 as mux_write_ms from lineitem)",
    "logs": "lg as (select event_id as line_no, case when event_id % 50 = 7 then '[ERROR] frame ' || event_id || ' failed' when event_id % 70 = 9 then 'batch_size: ' || (event_id % 8 + 1) when event_id % 90 = 11 then '[WARN] TensorRT fallback' else 'progress: completed ' || (event_id + 1) || ' filter frames, wall_clock_fps=' || printf('%.2f', value) end as text, event_type = 'error' as is_error from events)",
}


def with_views(*names: str, then: str = "", recursive: bool = False) -> str:
    return "with " + "recursive " * recursive + ", ".join([SQL[n] for n in names] + ([then] if then else [])) + " "
