"""Shared helpers: reading tables, cutting lineage, and byte-level views of Arrow text batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import prepare, shared_folder

#: Texts are handed to the vectorised kernels in slices of about this many bytes.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    done = df.checkpoint(eager=True)
    del df  # it holds the plan that ran
    gc.collect()  # shuffles behind the checkpoint are no longer needed: let Spark's cleaner drop their files
    sc._jvm.System.gc()
    return done


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write as a Parquet table in the shared folder and read it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8(col: str = "text"):
    """A text column as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary").alias(col)


def packed(df: DataFrame, col: str = "text") -> DataFrame:
    """``df`` with a binary column compressed, for a shuffle that moves whole texts; ``unpacked`` undoes it in the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in slices(batches, col):
            yield b.set_column(b.schema.get_field_index(col), col, pa.array([press.compress(t) for t in b.column(col).to_pylist()], pa.binary()))

    return df.mapInArrow(run, df.schema)


def unpacked(batches: Iterator[pa.RecordBatch], col: str = "text", limit: int = CHUNK_BYTES // 4) -> Iterator[pa.RecordBatch]:
    """Batches of ``packed`` rows with their texts, a few MB of them at a time."""
    press = zstandard.ZstdDecompressor()
    for b in slices(batches, col, limit):
        yield b.set_column(b.schema.get_field_index(col), col, pa.array([press.decompress(t) for t in b.column(col).to_pylist()], pa.binary()))


def slices(batches: Iterator[pa.RecordBatch], col: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds about ``limit`` bytes of ``col`` (one longer text stays whole)."""
    for b in batches:
        if not b.num_rows:
            continue
        lens = np.asarray(pc.binary_length(b.column(col)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        part = (np.cumsum(lens) - lens) // limit
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield b.slice(lo, hi - lo)


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, a line feed after each, and where each begins (one more entry: the end)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8) if texts else np.zeros(0, np.uint8)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    return buf, np.r_[0, np.cumsum(lens)]


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space. The last byte is a line feed."""
    if not buf.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = SPACE[buf]
    turn = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        turn = np.r_[0, turn]
    return turn[0::2], turn[1::2]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (the public splitmix64 constants)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h
