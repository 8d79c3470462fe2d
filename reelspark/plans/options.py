"""Run options: one table of flags drives defaults, parsing, validation, the summary and the command line."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from typing import Any

#: limits (fixed values)
MOST_CLASSES = 128
MOST_PATH = 1024
MOST_NAME = 64


class OptionError(ValueError):
    pass


@dataclass(frozen=True)
class Options:
    """All options of a run with their defaults (fixed values)."""

    input: str = "data/input/15592600_3840_2160_60fps.mp4"
    output: str = "data/output/output.mp4"
    benchmark: str = "benchmarks/results.csv"
    task: str = "filter"
    model: str = "models/yolov5s_trt11.engine"
    labels: str = "models/coco.names"
    detections: str = "benchmarks/detections.csv"
    confidence: float = 0.25
    iou_threshold: float = 0.45
    input_width: int = 640
    input_height: int = 640
    class_ids: tuple[int, ...] = ()
    classes: tuple[str, ...] = ()
    runtime: str = "auto"
    backend_device: str = "cuda"
    allow_host_backend: bool = False
    list_backends: bool = False
    model_info: bool = False
    model_type: str = "auto"
    precision: str = "fp16"
    encoder: str = "libx264"
    output_format: str = "auto"
    mode: str = "cpu"
    filter: str = "grayscale"
    max_frames: int = 0
    frame_slots: int = 3
    decoder_threads: int = 4
    encoder_threads: int = 4
    processor_workers: int = 2
    benchmark_enabled: bool = True
    lossless: bool = False
    memory_profile: str = "auto"
    memory_budget_mb: int = 0
    progress_interval: int = 300
    ffmpeg_log_level: str = "warning"
    decoder: str = "cpu"
    decoder_fallback: str = "cpu"
    draw_boxes: bool = False
    box_thickness: int = 2
    box_confidence: float = 0.0
    batch_size: int = 1  # 0: automatic
    inflight_batches: int = 1  # 0: automatic
    auto_tune: bool = False
    target_fps: float = 0.0
    vram_budget_ratio: float = 0.375
    vram_reserve_mb: int = 0
    profile_hardware: bool = False
    pipeline_overlap: str = "auto"
    parallel_inference: str = "auto"
    inference_contexts: int = 0  # 0: automatic
    max_detections_per_frame: int = 300
    extra: dict = field(default_factory=dict, hash=False, compare=False)


def whole(low: int) -> Callable[[str], int]:
    def parse(s: str) -> int:
        if not re.fullmatch(r"\s*[+-]?\d+", s) or not -(2**31) <= int(s) < 2**31 or int(s) < low:
            raise OptionError
        return int(s)

    return parse


def number(low: float, high: float = float("inf"), open_low: bool = False) -> Callable[[str], float]:
    def parse(s: str) -> float:
        try:
            v = float(s) if s == s.rstrip() and s else None
        except ValueError:
            v = None
        if v is None or not low <= v <= high or (open_low and v == low):
            raise OptionError
        return v

    return parse


def one_of(*names: str, **aliases: str) -> Callable[[str], str]:
    def parse(s: str) -> str:
        s = aliases.get(s, s)
        if s not in names:
            raise OptionError
        return s

    return parse


def path(s: str) -> str:
    if len(s) >= MOST_PATH:
        raise OptionError
    return s


def auto_or(parse: Callable[[str], int]) -> Callable[[str], int]:
    return lambda s: 0 if s == "auto" else parse(s)


def id_list(s: str) -> tuple[int, ...]:
    ids = dict.fromkeys(whole(0)(t.strip(" \t")) for t in s.split(","))
    if len(ids) > MOST_CLASSES:
        raise OptionError
    return tuple(ids)


def name_list(s: str) -> tuple[str, ...]:
    names = dict.fromkeys(t for t in (x.strip(" \t") for x in s.split(",")) if t)
    if len(names) > MOST_CLASSES or any(len(n) >= MOST_NAME for n in names):
        raise OptionError
    return tuple(names)


RUNTIMES = one_of("auto", "tensorrt", "onnxruntime", "torchscript", onnx="onnxruntime", torch="torchscript", libtorch="torchscript")


def no_auto(s: str) -> str:
    if s == "auto":
        raise OptionError
    return RUNTIMES(s)


#: The flags and their domains (fixed values). flag: (field, parser of its value) or, for a switch, the fields that it sets
FLAGS: dict[str, Any] = {
    "--input": ("input", path), "--output": ("output", path), "--benchmark": ("benchmark", path), "--task": ("task", one_of("filter", "detect")), "--model": ("model", path), "--labels": ("labels", path), "--detections": ("detections", path),
    "--confidence": ("confidence", number(0, 1)), "--iou-threshold": ("iou_threshold", number(0, 1)), "--input-size": ("input_width input_height", whole(1)), "--input-width": ("input_width", whole(1)), "--input-height": ("input_height", whole(1)),
    "--class-ids": ("class_ids", id_list), "--classes": ("classes", name_list), "--inference-backend": ("runtime", no_auto), "--runtime": ("runtime", RUNTIMES), "--backend-device": ("backend_device", one_of("cuda", "cpu")),
    "--allow-host-backend": {"allow_host_backend": True}, "--list-backends": {"list_backends": True}, "--model-info": {"model_info": True}, "--model-type": ("model_type", one_of("auto", "yolov5")), "--precision": ("precision", one_of("fp16", "fp32")),
    "--encoder": ("encoder", one_of("libx264", "libx264rgb", "h264_nvenc", "mpeg4")), "--output-format": ("output_format", one_of("auto", "mp4", "mkv")), "--mode": ("mode", one_of("cpu", "gpu")),
    "--filter": ("filter", one_of("grayscale", "blur3x3", "blur5x5", "blur9x9", "blur13x13")), "--max-frames": ("max_frames", whole(0)), "--frame-slots": ("frame_slots", whole(1)), "--decoder-threads": ("decoder_threads", whole(1)),
    "--encoder-threads": ("encoder_threads", whole(1)), "--processor-workers": ("processor_workers", whole(1)), "--no-benchmark": {"benchmark_enabled": False}, "--lossless": {"lossless": True}, "--lossy": {"lossless": False},
    "--memory-profile": ("memory_profile", one_of("auto", "low", "balanced", "manual")), "--memory-budget-mb": ("memory_budget_mb", whole(0)), "--progress-interval": ("progress_interval", whole(0)), "--no-progress": {"progress_interval": 0},
    "--ffmpeg-log-level": ("ffmpeg_log_level", one_of("quiet", "error", "warning", "info", "debug")), "--decoder": ("decoder", one_of("cpu", "nvdec")), "--decoder-fallback": ("decoder_fallback", one_of("cpu", "none")),
    "--no-decoder-fallback": {"decoder_fallback": "none"}, "--draw-boxes": {"draw_boxes": True}, "--no-draw-boxes": {"draw_boxes": False}, "--box-thickness": ("box_thickness", whole(1)), "--box-confidence": ("box_confidence", number(0, 1)),
    "--batch-size": ("batch_size", auto_or(whole(1))), "--inflight-batches": ("inflight_batches", auto_or(whole(1))), "--auto-tune": {"auto_tune": True, "batch_size": 0, "inflight_batches": 0}, "--target-fps": ("target_fps", number(0)),
    "--vram-budget-ratio": ("vram_budget_ratio", number(0, 1, open_low=True)), "--vram-reserve-mb": ("vram_reserve_mb", whole(0)), "--profile-hardware": {"profile_hardware": True, "auto_tune": True, "batch_size": 0, "inflight_batches": 0},
    "--pipeline-overlap": ("pipeline_overlap", one_of("auto", "on", "off")), "--parallel-inference": ("parallel_inference", one_of("auto", "on", "off")), "--inference-contexts": ("inference_contexts", auto_or(whole(1))),
}


def with_extension(p: str, ext: str) -> str:
    head, dot, _ = p.rpartition(".")
    return f"{head}.{ext}" if dot and "/" not in p[len(head) :] and "\\" not in p[len(head) :] else f"{p}.{ext}"


def runtime_of(model: str) -> str:
    ext = re.search(r"\.([^./\\]*)$", model.lower())
    kinds = {"engine": "tensorrt", "plan": "tensorrt", "onnx": "onnxruntime", "pt": "torchscript", "ts": "torchscript", "torchscript": "torchscript"}
    return kinds.get(ext[1], "auto") if ext else "auto"


def parse(argv: list[str]) -> Options:
    """Options of a command line; later flags win. Raises OptionError with the reason."""
    got: dict[str, Any] = {}
    args = iter(argv)
    for flag in args:
        if flag not in FLAGS:
            raise OptionError(f"unknown option: {flag}")
        rule = FLAGS[flag]
        if isinstance(rule, dict):
            got |= rule
            continue
        value = next(args, None)
        if value is None:
            raise OptionError(f"missing value for {flag}")
        try:
            parsed = rule[1](value)
        except OptionError:
            raise OptionError(f"invalid value for {flag}: {value}") from None
        got |= dict.fromkeys(rule[0].split(), parsed)
    out = Options(**got)
    if out.task == "detect" and not (out.list_backends or out.model_info):
        found = runtime_of(out.model)
        if found == "auto":
            raise OptionError("unsupported model extension. Supported: .engine, .plan, .onnx, .pt, .ts, .torchscript")
        if out.runtime not in ("auto", found):
            raise OptionError(f"model extension selects {found} but --runtime is {out.runtime}")
    return replace(out, output=with_extension(out.output, out.output_format)) if out.output_format != "auto" else out


SECTIONS = {
    "common": "input task max_frames progress_interval benchmark_enabled benchmark".split(),
    "filter": "output mode filter encoder lossless frame_slots decoder_threads encoder_threads processor_workers memory_profile memory_budget_mb".split(),
    "detect": "model labels detections runtime backend_device precision confidence iou_threshold input_width input_height class_ids classes decoder draw_boxes batch_size inflight_batches auto_tune".split(),
}


def summary(o: Options) -> str:
    """``name: value`` lines of the sections that the task uses."""
    shown = SECTIONS["common"] + SECTIONS[o.task] + (["output", "encoder", "box_thickness", "box_confidence"] if o.task == "detect" and o.draw_boxes else [])
    text = lambda v: ",".join(map(str, v)) if isinstance(v, tuple) else ("on" if v else "off") if isinstance(v, bool) else str(v)
    return "\n".join(f"{n}: {text(getattr(o, n))}" for n in shown)


def command(program: str, o: Options) -> list[str]:
    """The argument list that gives ``o`` back: every option that is not at its default."""
    switches = [flag for flag, rule in FLAGS.items() if isinstance(rule, dict) and (k := next(iter(rule))) and getattr(o, k) == rule[k] != getattr(Options(), k) and k != "progress_interval" and flag != "--no-decoder-fallback"]
    base, argv = parse(switches), [program, *switches]
    text = lambda flag, v: ",".join(map(str, v)) if isinstance(v, tuple) else "auto" if flag in ("--batch-size", "--inflight-batches", "--inference-contexts") and v == 0 else str(v)
    for flag, rule in FLAGS.items():
        if not isinstance(rule, dict) and " " not in rule[0] and flag != "--inference-backend" and (v := getattr(o, rule[0])) != getattr(base, rule[0]):
            argv += [flag, text(flag, v)]
    return argv


#: what all presets have in common (fixed values)
PRESET_COMMON: dict[str, Any] = {
    "input": "data/input/people_4k_30min_stream_test.mp4", "model": "models/yolov5s.onnx", "labels": "models/coco.names", "ffmpeg_log_level": "error", "task": "detect", "runtime": "onnxruntime", "backend_device": "cuda",
    "filter": "grayscale", "mode": "gpu", "confidence": 0.25, "iou_threshold": 0.45, "input_width": 640, "input_height": 640, "progress_interval": 60, "box_thickness": 3, "box_confidence": 0.0,
    "benchmark_enabled": True, "lossless": False, "decoder_fallback": "cpu", "class_ids": (), "auto_tune": False, "profile_hardware": False, "batch_size": 1, "inflight_batches": 1, "pipeline_overlap": "auto",
    "parallel_inference": "auto", "inference_contexts": 0, "target_fps": 0.0, "vram_budget_ratio": 0.375, "vram_reserve_mb": 0, "max_frames": 0,
}
_STAGED: dict[str, Any] = {
    "decoder": "nvdec", "encoder": "h264_nvenc", "runtime": "tensorrt", "model": "models/yolov5s_trt11.engine", "output_format": "mkv", "draw_boxes": True, "auto_tune": True, "batch_size": 2, "inflight_batches": 3,
    "pipeline_overlap": "on", "parallel_inference": "on", "inference_contexts": 2, "target_fps": 60.0,
}
#: the launcher's presets: family name of the outputs, and what differs (fixed values; the launcher's encoder "none" is the default one, as nothing is encoded)
PRESETS: dict[str, tuple[str, dict[str, Any]]] = {
    "People Detection - CSV Only": ("people_csv", {"decoder": "cpu", "precision": "fp32", "output_format": "auto", "draw_boxes": False}),
    "People Detection - Staged Annotated Video": ("people_annotated", {"decoder": "nvdec", "encoder": "h264_nvenc", "precision": "fp32", "output_format": "mkv", "draw_boxes": True, "auto_tune": True, "batch_size": 0, "inflight_batches": 0}),
    "Fast Staged GPU Annotated Video": ("fast_gpu_annotated", {**_STAGED, "precision": "fp16"}),
    "Safe CPU Detection": ("safe_cpu_detection", {"decoder": "cpu", "backend_device": "cpu", "precision": "fp32", "output_format": "auto", "draw_boxes": False, "max_frames": 120}),
    "NVDEC/NVENC Stress Test": ("nvdec_nvenc_stress", {**_STAGED, "precision": "fp32", "decoder_fallback": "none"}),
}


def artifacts(family: str, ext: str) -> dict[str, str]:
    """Output paths of a run by the family name."""
    return {"output": f"data/output/{family}_video.{ext}", "detections": f"benchmarks/detections/{family}_detections.csv", "benchmark": f"benchmarks/benchmarks/{family}_benchmark.csv"}


def preset(o: Options, name: str) -> Options:
    """``o`` with a preset's options and output paths; ``Custom`` changes nothing."""
    if name == "Custom":
        return o
    family, own = PRESETS[name]
    ext = own["output_format"] if own["output_format"] != "auto" else "mkv"
    return replace(o, **{**PRESET_COMMON, **own, **artifacts(family, ext)})


def issues(o: Options, exists: Callable[[str], bool]) -> list[str]:
    """What stands in the way of a run; ``exists`` tells whether a path is there."""
    if o.profile_hardware and o.task == "detect":
        return []
    folders = (("Input", o.input), ("Output", o.output), ("Detections", o.detections), ("Benchmark", o.benchmark))
    found = [f"{name} folder was not found." for name, p in folders if "/" in p and not exists(p.rpartition("/")[0])]
    found += [] if exists(o.input) else ["Input video was not found."]
    if o.task == "detect":
        runtime = runtime_of(o.model) if o.runtime == "auto" else o.runtime
        checks = (
            (runtime == "tensorrt" and o.backend_device == "cpu", "TensorRT runs on cuda only."), (o.input_width <= 0 or o.input_height <= 0, "Input width and height must be greater than 0."), (o.draw_boxes and not (o.decoder == "nvdec" and o.backend_device == "cuda" and o.encoder == "h264_nvenc"), "Annotated detection requires decoder nvdec, device cuda and encoder h264_nvenc."),
            (not exists(o.model), "Model file was not found."), (not exists(o.labels), "Labels file was not found."), (o.benchmark_enabled and o.detections == o.benchmark, "Detections and benchmark should use different paths."),
        )
        found += [text for bad, text in checks if bad]
    return found


def windows_quoted(arg: str) -> str:
    """One argument quoted for a Windows command line: backslashes before a quotation mark are doubled."""
    if arg and not re.search(r'[ \t\n\v"]', arg):
        return arg
    return '"' + re.sub(r'(\\*)(")', r"\1\1\\\2", re.sub(r"(\\+)$", r"\1\1", arg)) + '"'


def encoder_of(o: Options, available: frozenset[str] = frozenset({"libx264", "libx264rgb", "mpeg4", "h264_nvenc"})) -> str:
    """The encoder a run ends up with: lossless libx264 keeps RGB, mpeg4 has no lossless mode, a missing libx264 becomes mpeg4."""
    if o.lossless and o.encoder == "mpeg4":
        raise OptionError("mpeg4 has no lossless mode")
    chosen = "libx264rgb" if o.lossless and o.encoder == "libx264" else o.encoder
    return "mpeg4" if chosen == "libx264" and chosen not in available else chosen


def field_names() -> list[str]:
    return [f.name for f in fields(Options)]
