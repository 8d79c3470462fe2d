"""Raw-frame files as a Python data source, and the other files of a run.

A raw file holds frames of one size and format one after another; frame i of a file is read by seeking, so a
file is split into ranges of frames. Paths may name any file system that Arrow opens (``hdfs://``, ``s3://``,
``file://``); a plain path must lie in a folder that all hosts share. There is no decoder here: files of a codec
are decoded elsewhere.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.text import label_lines, numeric_prefix

SCHEMA = "video string, frame_index bigint, width int, height int, format string, timestamp_ms double, data binary"
RANGE = 64


def frame_bytes(w: int, h: int, fmt: str) -> int:
    if w <= 0 or h <= 0 or (fmt == "nv12" and (w % 2 or h % 2)):
        return 0
    return {"rgb24": 3 * w * h, "gray8": w * h, "nv12": w * h * 3 // 2}.get(fmt, 0)


def opened(path: str):
    """(file system, path within it); a fresh one wherever it is called, so nothing of it is pickled."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class FrameRange(InputPartition):
    path: str
    first: int
    last: int


class RawFrames(DataSource):
    """``spark.read.format("rawframes")`` with options path, width, height, format, fps, max_frames."""

    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RawReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RawWriter(self.options)


class RawReader(DataSourceReader):
    def __init__(self, options):
        self.w, self.h, self.fmt = int(options["width"]), int(options["height"]), options.get("format", "rgb24")
        self.fps, self.most, self.path = float(options.get("fps", 0)), int(options.get("max_frames", 0)), options["path"]
        self.size = frame_bytes(self.w, self.h, self.fmt)
        if not self.size:
            raise ValueError(f"no frames of {self.w}x{self.h} {self.fmt}")

    def partitions(self):
        from pyarrow import fs

        files, path = opened(self.path)
        info = files.get_file_info(path)
        found = files.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
        out = []
        for p in sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(".raw")), key=lambda f: f.path):
            n, rest = divmod(p.size, self.size)
            if rest:
                raise ValueError(f"{p.path} ends within a frame")
            n = min(n, self.most) if self.most else n  # the limit is applied at the source
            out += [FrameRange(p.path, a, min(a + RANGE, n)) for a in range(0, n, RANGE)]
        return out

    def read(self, partition: FrameRange) -> Iterator[tuple]:
        files, _ = opened(self.path)
        with files.open_input_file(partition.path) as f:
            f.seek(partition.first * self.size)
            for i in range(partition.first, partition.last):
                stamp = i * 1000 / self.fps if self.fps > 0 else 0.0
                yield os.path.basename(partition.path), i, self.w, self.h, self.fmt, stamp, f.read(self.size)


@dataclass
class Wrote(WriterCommitMessage):
    rows: int
    path: str


class RawWriter(DataSourceWriter):
    """One raw file a partition, written aside and renamed on commit; frames must come in order and be of one size.

    Names hold the write and the attempt, so appends and repeated tasks never meet in a file. A write that had
    rows must leave as many frames.
    """

    def __init__(self, options):
        self.path, self.write_id = options["path"], uuid.uuid4().hex
        files, path = opened(self.path)
        files.create_dir(path, recursive=True)

    def write(self, rows) -> Wrote:
        from pyspark import TaskContext

        t = TaskContext.get()
        files, path = opened(self.path)
        name = f"{path}/part-{t.partitionId():05d}-{self.write_id}-{t.taskAttemptId()}.raw"
        n, last, size = 0, -1, None
        with files.open_output_stream(name + ".tmp") as f:
            for r in rows:
                if r.frame_index <= last or (size is not None and len(r.data) != size):
                    raise ValueError(f"frame {r.frame_index} is out of order or of another size")
                last, size, n = r.frame_index, len(r.data), n + 1
                f.write(r.data)
        return Wrote(n, name)

    def commit(self, messages) -> None:
        files, _ = opened(self.path)
        for m in messages:
            if m is not None and m.rows:
                files.move(m.path + ".tmp", m.path)
            elif m is not None:
                files.delete_file(m.path + ".tmp")

    def abort(self, messages) -> None:
        files, _ = opened(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(m.path + ".tmp")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawFrames)


def stamps(df: DataFrame, fallback_fps: float = 30.0) -> DataFrame:
    """timestamp_ms of container stamps: time base times pts, 0 without a pts. Rates fall back to 30."""
    return df.withColumn("timestamp_ms", F.coalesce(F.col("pts") * F.try_divide("tb_num", "tb_den") * 1000, F.lit(0.0))).withColumn("fps", F.coalesce(F.try_divide("rate_num", "rate_den"), F.lit(fallback_fps)))


def read_labels(spark: SparkSession, path: str, left: bool = True) -> DataFrame:
    """(class_id, class_name) of a label file, one class a line; a missing file is an empty table."""
    try:
        lines = spark.read.text(path, wholetext=True)
        lines = lines.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "text"))
        return label_lines(lines, left)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "class_id int, class_name string")


def read_report(spark: SparkSession, path: str, column: str = "total_ms") -> DataFrame:
    """(value) of a named column of a benchmark file; rows without a number there are skipped.

    Commas part the cells, quotation marks mean nothing. Every part file begins with the header.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"))
    first = lines.first()
    names = first.line.split(",") if first else []
    if column not in names:
        raise ValueError(f"{path} has no column {column}")
    cell = F.get(F.split("line", ","), F.lit(names.index(column)))
    return lines.filter(F.col("line") != first.line).select(numeric_prefix(cell).alias("value")).filter("value is not null")


def source_info(width: int, height: int, fps: float, frames: DataFrame) -> DataFrame:
    """One row about a source: size, rate (30 if it is not known), frames, seconds."""
    rate = fps if fps > 0 else 30.0
    n = frames.agg(F.count(F.lit(1)).alias("total_frames"))
    return n.select(F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(float(rate)).alias("fps"), "total_frames", (F.col("total_frames") / rate).alias("duration_sec"))


VIDEO = ("mp4", "mkv", "mov", "avi", "m4v", "webm", "mpg", "mpeg")


def listing(spark: SparkSession, folder: str, extensions: tuple[str, ...] = VIDEO) -> DataFrame:
    """Files of a folder with one of the extensions (any case), by name; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", F.element_at(F.split("path", "/"), -1).alias("file"))
    return files.filter(F.lower(F.element_at(F.split("file", r"\."), -1)).isin(*extensions)).orderBy("file")


#: extensions of model files by runtime (fixed values)
MODELS = {"tensorrt": ("engine", "plan"), "onnxruntime": ("onnx",), "torchscript": ("pt", "ts", "torchscript")}


def models(spark: SparkSession, folder: str, runtime: str = "auto") -> DataFrame:
    """Model files of a folder that a runtime reads, or any runtime, by name."""
    return listing(spark, folder, MODELS[runtime] if runtime in MODELS else tuple(e for group in MODELS.values() for e in group))


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """One model file, read through Spark so that any of its file systems will do."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()  # one file
    if len(rows) != 1 or not rows[0].content:
        raise ValueError(f"{path} is not one model file")
    return bytes(rows[0].content)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a child's output, carriage returns dropped."""
    return spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", r"\r$", "").alias("text"))
