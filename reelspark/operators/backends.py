"""Inference backends as functions over partitions of preprocessed frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import prepare
from .detect import first_detections

SCHEMA = "frame_index bigint, dims array<int>, output array<float>"


class Unavailable(RuntimeError):
    pass


def stand_in(model: bytes | None, shape: tuple[int, int]) -> Callable[[np.ndarray], np.ndarray]:
    """A deterministic detector for tests: one row of output for each 8 x 8 cell, from the cell's mean colours."""
    h, w = shape

    def run(x: np.ndarray) -> np.ndarray:
        cells = x.astype(np.float64).reshape(3, h // 8, 8, w // 8, 8).mean(axis=(2, 4)).reshape(3, -1).T
        y, c = np.divmod(np.arange(len(cells)), w // 8)
        return np.concatenate([np.stack([c * 8 + 4, y * 8 + 4, np.full(len(c), 8), np.full(len(c), 8), cells.mean(axis=1)], axis=1), cells], axis=1)[None].astype(np.float32)

    return run


def onnx_cpu(model: bytes | None, shape: tuple[int, int]) -> Callable[[np.ndarray], np.ndarray]:
    """ONNX Runtime on the CPU; one session a worker, float32 input of 1 x 3 x H x W, the first output that looks like detections."""
    import onnxruntime as ort

    s = ort.InferenceSession(model, providers=["CPUExecutionProvider"])
    (only,) = s.get_inputs()
    if only.type != "tensor(float)" or len(only.shape) != 4 or any(isinstance(d, int) and d != want for d, want in zip(only.shape, (1, 3, *shape), strict=True)):
        raise ValueError(f"the model's input is {only.type} {only.shape}")

    def run(x: np.ndarray) -> np.ndarray:
        found = first_detections(s.run(None, {only.name: x[None].astype(np.float32)}))
        if found is None:
            raise ValueError("none of the model's outputs looks like detections")
        return found

    return run


def missing(name: str):
    def make(model: bytes | None, shape: tuple[int, int]):
        raise Unavailable(f"{name} is not available here")

    return make


REGISTRY = {"stand-in": stand_in, "onnxruntime": onnx_cpu, "tensorrt": missing("tensorrt"), "torchscript": missing("torchscript")}


def infer(frames: DataFrame, runtime: str, model: bytes | None, width: int, height: int, *, half: bool = False) -> DataFrame:
    """(frame_index, dims, output) of (frame_index, planes as float32 or, with ``half``, float16 bytes).

    Sessions live as long as their task. Half-precision planes are widened before, outputs after the run.
    """
    make = REGISTRY[runtime]
    sc = prepare(frames.sparkSession).sparkContext
    shared = sc.broadcast(model)  # one model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = make(shared.value, (height, width))
        for b in batches:
            dims, outs = [], []
            for planes in b.column("planes").to_pylist():
                y = session((half_to_float(planes) if half else np.frombuffer(planes, np.float32)).reshape(3, height, width))
                dims.append(list(y.shape))
                outs.append(y.astype(np.float32).reshape(-1))
            yield pa.RecordBatch.from_arrays([b.column("frame_index"), pa.array(dims, pa.list_(pa.int32())), pa.array(outs, pa.list_(pa.float32()))], ["frame_index", "dims", "output"])

    return frames.select("frame_index", "planes").mapInArrow(run, SCHEMA)


def half_to_float(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float16).astype(np.float32)
