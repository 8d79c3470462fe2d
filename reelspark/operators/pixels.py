"""Exact pixel operators on whole frames.

Two forms with equal results: expressions over a frame's array of values, and numpy on binary frames in Arrow
batches for real frame sizes. Neither explodes pixels nor shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import prepare

KERNELS = {"grayscale": 0, "blur3x3": 3, "blur5x5": 5, "blur9x9": 9, "blur13x13": 13}


def _at(px: Column, i: Column) -> Column:
    return F.get(px, i)


def grayscale(px: Column) -> Column:
    """Every channel becomes trunc(0.299 r + 0.587 g + 0.114 b + 0.5)."""
    i = F.sequence(F.lit(0), F.size(px) - 1)

    def value(k):
        b = k - k % 3
        return (F.lit(0.299) * _at(px, b) + F.lit(0.587) * _at(px, b + 1) + F.lit(0.114) * _at(px, b + 2) + F.lit(0.5)).cast("int")

    return F.transform(i, value)


def box_blur(df: DataFrame, k: int, width: int, height: int, channels: int = 3, *, col: str = "px") -> DataFrame:
    """k x k box blur with repeated edges and a truncating division, as an expression: for small frames."""
    r, px = k // 2, F.col(col)
    clamp = lambda c, most: F.least(F.greatest(c, F.lit(0)), F.lit(most - 1))

    def value(i):
        x, y, c = F.floor(i / channels).cast("int") % width, F.floor(i / (channels * width)).cast("int"), i % channels
        around = F.sequence(F.lit(0), F.lit(k * k - 1))
        at = lambda o: (clamp(y + F.floor(o / k).cast("int") - r, height) * width + clamp(x + o % k - r, width)) * channels + c
        return F.floor(F.aggregate(around, F.lit(0), lambda acc, o: acc + _at(px, at(o))) / (k * k)).cast("int")

    return df.withColumn(col, F.transform(F.sequence(F.lit(0), F.size(px) - 1), value))


def filter_arrays(df: DataFrame, name: str, width: int, height: int) -> DataFrame:
    """(frame_index, px) of RGB frames of one size, filtered with numpy, all frames of an Arrow batch at once."""
    k = KERNELS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = b.column("px").flatten().to_numpy().reshape(b.num_rows, height, width, 3)
                out = gray_frames(a) if not k else blur_frames(a, k)
                yield pa.RecordBatch.from_arrays([b.column("frame_index"), pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, height * width * 3, dtype=np.int32)), pa.array(out.reshape(-1).astype(np.int32)))], ["frame_index", "px"])

    prepare(df.sparkSession)
    return df.select("frame_index", "px").mapInArrow(run, "frame_index bigint, px array<int>")


def apply_filter(df: DataFrame, name: str, width: int, height: int) -> DataFrame:
    k = KERNELS[name]
    return df.withColumn("px", grayscale(F.col("px"))) if k == 0 else box_blur(df, k, width, height)


def _window_sum(a: np.ndarray, k: int, axis: int) -> np.ndarray:
    """Sums of ``k`` neighbours along an axis, of sums of 1, 2, 4, ... neighbours: additions in the logarithm of ``k``."""
    n = a.shape[axis] - k + 1
    part = lambda x, at, size: x[(slice(None),) * axis + (slice(at, at + size),)]
    out, at, width, power = None, 0, 1, a
    while True:
        if k & width:
            out = part(power, at, n) if out is None else out + part(power, at, n)
            at += width
        if 2 * width > k:
            return out
        power = part(power, 0, power.shape[axis] - width) + part(power, width, power.shape[axis] - width)
        width *= 2


def blur_frames(a: np.ndarray, k: int) -> np.ndarray:
    """The same blur of (n, h, w, c) bytes, in rows and then columns; sums of up to 13 x 13 bytes fit 16 bits."""
    r = k // 2
    p = np.pad(a.astype(np.uint16), ((0, 0), (r, r), (r, r), (0, 0)), mode="edge")
    return (_window_sum(_window_sum(p, k, 2), k, 1) // np.uint16(k * k)).astype(np.uint8)


def gray_frames(a: np.ndarray) -> np.ndarray:
    g = (0.299 * a[..., 0] + 0.587 * a[..., 1] + 0.114 * a[..., 2] + 0.5).astype(np.uint8)
    return np.repeat(g[..., None], 3, axis=-1)


def filter_frames(frames: DataFrame, name: str) -> DataFrame:
    """Frames (frame_index, width, height, data) of RGB24 bytes, filtered one by one in Arrow batches."""
    k = KERNELS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 16):  # few rows at a time, as frames may be large
                part = b.slice(i, 16)
                done = []
                for w, h, d in zip(part.column("width").to_pylist(), part.column("height").to_pylist(), part.column("data").to_pylist(), strict=True):
                    a = np.frombuffer(d, np.uint8).reshape(1, h, w, 3)
                    done.append((gray_frames(a) if not k else blur_frames(a, k)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("frame_index"), part.column("width"), part.column("height"), pa.array(done, pa.binary())], ["frame_index", "width", "height", "data"])

    prepare(frames.sparkSession)
    return frames.select("frame_index", "width", "height", "data").mapInArrow(run, frames.select("frame_index", "width", "height", "data").schema)


def converted(a: np.ndarray, to: str) -> np.ndarray:
    """RGB frames (n, h, w, 3) as bytes of another format, (n, size): gray8 or nv12 (chroma of the mean of two by two pixels)."""
    r, g, b = (a[..., c].astype(np.float64) for c in range(3))
    luma = np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)
    if to == "gray8":
        return luma.astype(np.uint8).reshape(len(a), -1)
    if to == "rgb24":
        return a.astype(np.uint8).reshape(len(a), -1)
    n, h, w = luma.shape
    if to != "nv12" or h % 2 or w % 2:
        raise ValueError(f"no {to} frame of {w}x{h}")
    r, g, b = (x.reshape(n, h // 2, 2, w // 2, 2).sum(axis=(2, 4)) / 4 for x in (r, g, b))
    # the coefficients that belong to those of ``yuv_to_rgb``
    u, v = 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b
    chroma = np.clip(np.floor(np.stack([u, v], axis=-1) + 0.5), 0, 255).reshape(n, -1)
    return np.concatenate([luma.reshape(n, -1), chroma], axis=1).astype(np.uint8)


def convert_arrays(df: DataFrame, to: str, width: int, height: int) -> DataFrame:
    """(frame_index, px) of RGB frames of one size as ``to`` (rgb24, gray8 or nv12)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = converted(b.column("px").flatten().to_numpy().reshape(b.num_rows, height, width, 3), to)
                yield pa.RecordBatch.from_arrays([b.column("frame_index"), pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.reshape(-1).astype(np.int32)))], ["frame_index", "px"])

    prepare(df.sparkSession)
    return df.select("frame_index", "px").mapInArrow(run, "frame_index bigint, px array<int>")


def valid_frame(width: Column, height: Column, fmt: Column, stride: Column, size: Column) -> Column:
    """Whether a frame's stride and size are those of its format, and not 0."""
    from ..plans.planner import frame_size, frame_stride

    return F.coalesce((size > 0) & (stride == frame_stride(width, fmt)) & (size == frame_size(width, height, fmt)), F.lit(False))


def letterbox(w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
    """(scale, pad_x, pad_y) that fit a frame into an input."""
    scale = F.least(to_w / w, to_h / h)
    return F.struct(scale.alias("scale"), ((to_w - w * scale) / 2).alias("pad_x"), ((to_h - h * scale) / 2).alias("pad_y"))


def yuv_to_rgb(y: Column, u: Column, v: Column) -> list[Column]:
    """Full-range colour conversion, clamped to 0..255 (fixed coefficients)."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))
    du, dv = u - F.lit(128.0), v - F.lit(128.0)
    return [clamp(y + F.lit(1.402) * dv), clamp(y - F.lit(0.344136) * du - F.lit(0.714136) * dv), clamp(y + F.lit(1.772) * du)]


def preprocess(px: Column, w: int, h: int, to_w: int, to_h: int, *, bilinear: bool) -> Column:
    """NV12 frame to (x, y, r, g, b) of a letterboxed input, channels in 0..1, outside 114/255.

    Bilinear luma with chroma of the truncated place, or nearest luma with chroma of the rounded one: the two
    ways of sampling give different values, and both are kept.
    """
    scale = min(to_w / w, to_h / h)
    pad_x, pad_y = (to_w - w * scale) / 2, (to_h - h * scale) / 2
    luma = lambda x, y: _at(px, y * w + x).cast("double")

    def pixel(i):
        x, y = i % to_w, F.floor(i / to_w).cast("int")
        sx, sy = (x - F.lit(pad_x)) / F.lit(scale), (y - F.lit(pad_y)) / F.lit(scale)
        inside = (sx >= 0) & (sy >= 0) & (sx <= w - 1) & (sy <= h - 1)
        if bilinear:
            x0, y0 = F.floor(sx).cast("int"), F.floor(sy).cast("int")
            x1, y1 = F.least(x0 + 1, F.lit(w - 1)), F.least(y0 + 1, F.lit(h - 1))
            fx, fy = sx - x0, sy - y0
            top = luma(x0, y0) + (luma(x1, y0) - luma(x0, y0)) * fx
            low = luma(x0, y1) + (luma(x1, y1) - luma(x0, y1)) * fx
            yy = top + (low - top) * fy
            cx, cy = F.least(x0 - x0 % 2, F.lit(w - 2)), F.least(F.floor(sy * 0.5).cast("int"), F.lit(h // 2 - 1))
        else:
            nx = F.least(F.floor(sx + 0.5).cast("int"), F.lit(w - 1))
            ny = F.least(F.floor(sy + 0.5).cast("int"), F.lit(h - 1))
            yy, cx, cy = luma(nx, ny), nx - nx % 2, F.floor(ny / 2).cast("int")
        at = w * h + cy * w + cx
        r, g, b = yuv_to_rgb(yy, _at(px, at).cast("double"), _at(px, at + 1).cast("double"))
        of = lambda c: F.when(inside, c / 255.0).otherwise(F.lit(114.0) / 255.0)
        return F.struct(x.alias("x"), y.alias("y"), of(r).alias("r"), of(g).alias("g"), of(b).alias("b"))

    return F.transform(F.sequence(F.lit(0), F.lit(to_w * to_h - 1)), pixel)


def preprocess_frame(data: bytes, w: int, h: int, to_w: int, to_h: int, *, bilinear: bool = True, dtype=np.float32) -> np.ndarray:
    """The same with numpy for one NV12 frame: planes (3, to_h, to_w) of ``dtype``."""
    a = np.frombuffer(data, np.uint8)
    luma, chroma = a[: w * h].reshape(h, w).astype(np.float64), a[w * h :].reshape(h // 2, w).astype(np.float64)
    scale = min(to_w / w, to_h / h)
    sx, sy = (np.arange(to_w) - (to_w - w * scale) / 2) / scale, (np.arange(to_h) - (to_h - h * scale) / 2) / scale
    inside = ((sy >= 0) & (sy <= h - 1))[:, None] & ((sx >= 0) & (sx <= w - 1))[None, :]
    sx, sy = np.clip(sx, 0, w - 1), np.clip(sy, 0, h - 1)
    if bilinear:
        x0, y0 = sx.astype(int), sy.astype(int)
        x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
        fx, fy = (sx - x0)[None, :], (sy - y0)[:, None]
        top = luma[y0][:, x0] + (luma[y0][:, x1] - luma[y0][:, x0]) * fx
        low = luma[y1][:, x0] + (luma[y1][:, x1] - luma[y1][:, x0]) * fx
        yy, cx, cy = top + (low - top) * fy, np.minimum(x0 & ~1, w - 2), np.minimum((sy * 0.5).astype(int), h // 2 - 1)
    else:
        nx, ny = np.minimum((sx + 0.5).astype(int), w - 1), np.minimum((sy + 0.5).astype(int), h - 1)
        yy, cx, cy = luma[ny][:, nx], nx & ~1, ny // 2
    u, v = chroma[cy][:, cx] - 128, chroma[cy][:, cx + 1] - 128
    rgb = np.stack([yy + 1.402 * v, yy - 0.344136 * u - 0.714136 * v, yy + 1.772 * u])
    return np.where(inside[None], np.clip(rgb, 0, 255) / 255, 114 / 255).astype(dtype)


def preprocess_arrays(df: DataFrame, w: int, h: int, to_w: int, to_h: int, *, bilinear: bool, half: bool = False) -> DataFrame:
    """(frame_index, r, g, b, planes): the channels of each preprocessed frame, and as float32 (or float16) bytes for a backend.

    With ``half`` the channels have the values that half precision leaves.
    """
    kind = np.float16 if half else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                done = [preprocess_frame(bytes(px), w, h, to_w, to_h, bilinear=bilinear, dtype=np.float64) for px in b.column("px").to_pylist()]
                planes = pa.array([x.astype(kind).tobytes() for x in done], pa.binary())
                done = [x.astype(kind).astype(np.float64) for x in done] if half else done
                yield pa.RecordBatch.from_arrays([b.column("frame_index"), *[pa.array([x[c].reshape(-1) for x in done], pa.list_(pa.float64())) for c in range(3)], planes], ["frame_index", "r", "g", "b", "planes"])

    prepare(df.sparkSession)
    return df.select("frame_index", "px").mapInArrow(run, "frame_index bigint, r array<double>, g array<double>, b array<double>, planes binary")


def overlay(px: Column, boxes: Column, w: int, h: int, thickness: int) -> Column:
    """Luma with 235 on the border of every box (array of x1, y1, x2, y2), grown inward.

    Corners are truncated and clamped to the frame, empty boxes skipped; a border thicker than its box may
    pass the opposite edge and is clamped to the frame only.
    """
    clamp = lambda c, most: F.least(F.greatest(c.cast("int"), F.lit(0)), F.lit(most - 1))
    whole = F.filter(F.transform(boxes, lambda b: F.struct(clamp(b["x1"], w).alias("x1"), clamp(b["y1"], h).alias("y1"), clamp(b["x2"], w).alias("x2"), clamp(b["y2"], h).alias("y2"))), lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
    t = thickness

    def on(b, x, y):
        rows = x.between(b["x1"], b["x2"]) & (y.between(b["y1"], F.least(b["y1"] + (t - 1), F.lit(h - 1))) | y.between(F.greatest(b["y2"] - (t - 1), F.lit(0)), b["y2"]))
        cols = y.between(b["y1"], b["y2"]) & (x.between(b["x1"], F.least(b["x1"] + (t - 1), F.lit(w - 1))) | x.between(F.greatest(b["x2"] - (t - 1), F.lit(0)), b["x2"]))
        return rows | cols

    return F.transform(px, lambda p, i: F.when((i < w * h) & F.exists(whole, lambda b: on(b, i % w, F.floor(i / w).cast("int"))), F.lit(235)).otherwise(p))
