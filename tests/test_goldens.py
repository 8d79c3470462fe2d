"""Hand-derived values for single operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import text as X
from reelspark.operators import dataflow as W
from reelspark.operators import detect as D
from reelspark.operators import pixels as P
from reelspark.operators import telemetry as T
from reelspark.plans import options as O
from reelspark.plans import planner as C
from reelspark.sources import frames as S
from reelspark.views import pattern


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


PATTERN_SUMS = {3: (29507, 31200, 33624), 5: (29463, 31173, 33545), 9: (28760, 31122, 33118), 13: (27344, 31139, 32471)}
PATTERN_MID = {3: (157, 157, 137), 5: (157, 140, 137), 9: (157, 126, 137), 13: (141, 123, 137)}
TWO = {3: (170, 85, 85, 170), 5: (153, 102, 102, 153), 9: (141, 113, 113, 141), 13: (137, 117, 117, 137)}


@pytest.mark.parametrize("k", [3, 5, 9, 13])
def test_blur(spark, k):
    px = np.array(pattern(spark).first().px)
    a = P.blur_frames(px.reshape(1, 15, 17, 3), k)[0]
    assert tuple(a.reshape(-1, 3).sum(0)) == PATTERN_SUMS[k] and tuple(a[7, 8]) == PATTERN_MID[k]
    two = P.blur_frames(np.array([255, 0, 0, 0, 255, 0]).reshape(1, 1, 2, 3), k)[0, 0]
    assert (*two[0, :2], *two[1, :2]) == TWO[k]
    assert (P.blur_frames(np.full((1, 9, 7, 3), 77), k) == 77).all()
    small = spark.createDataFrame([(0, list(range(0, 240, 5)))], "frame_index bigint, px array<int>")
    assert P.box_blur(small, k, 4, 4).first().px == P.filter_arrays(small, f"blur{k}x{k}", 4, 4).first().px


def test_gray(spark):
    px = np.array(pattern(spark).first().px)
    g = P.gray_frames(px.reshape(1, 15, 17, 3))[0]
    assert g[..., 0].sum() == 31009 and g[0, :4, 0].tolist() == [0, 9, 19, 28] and g[14, 16, 0] == 154
    assert P.apply_filter(pattern(spark), "grayscale", 17, 15).first().px == g.reshape(-1).tolist()
    assert P.gray_frames(np.array([[[[255, 0, 0], [0, 255, 0]]]]))[0, 0, :, 0].tolist() == [76, 150]


def test_letterbox_and_sizes(spark):
    for w, h, want in ((3840, 2160, (1 / 6, 0, 140)), (1080, 1920, (1 / 3, 140, 0)), (640, 640, (1, 0, 0))):
        assert one(spark, P.letterbox(F.lit(w), F.lit(h), F.lit(640), F.lit(640)).alias("k"))[0] == pytest.approx(want)
    for w, h, f, stride, size in ((8, 2, "rgb24", 24, 48), (8, 2, "gray8", 8, 16), (8, 2, "nv12", 8, 24), (7, 2, "nv12", 7, 0), (8, 3, "nv12", 8, 0), (0, 2, "rgb24", 0, 0), (3840, 2160, "nv12", 3840, 12441600)):
        assert one(spark, C.frame_stride(F.lit(w), F.lit(f)), C.frame_size(F.lit(w), F.lit(h), F.lit(f))) == (stride, size)
        assert S.frame_bytes(w, h, f) == size


def test_preprocess_forms_agree(spark):
    rng = random.Random(0)
    data = bytes(rng.randrange(256) for _ in range(48))
    df = spark.createDataFrame([(0, list(data))], "frame_index bigint, px array<int>")
    for bilinear in (False, True):
        rows = df.select(F.explode(P.preprocess(F.col("px"), 8, 4, 8, 8, bilinear=bilinear)).alias("p")).select("p.*").collect()
        planes = P.preprocess_frame(data, 8, 4, 8, 8, bilinear=bilinear, dtype=np.float64)
        for r in rows:
            assert planes[:, r.y, r.x] == pytest.approx((r.r, r.g, r.b))
    assert P.preprocess_frame(data, 8, 4, 8, 8, dtype=np.float16).dtype == np.float16


def test_overlay_border(spark):
    df = spark.createDataFrame([([0] * 48, [(1.0, 1.0, 5.0, 4.0)])], "px array<int>, b array<struct<x1:double,y1:double,x2:double,y2:double>>")
    got = df.select(P.overlay(F.col("px"), F.col("b"), 8, 6, 1)).first()[0]
    assert sum(p == 235 for p in got) == 14


BOXES = [(0, 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 2, 0, 0.8, 1.0, 0.0, 11.0, 10.0), (0, 3, 1, 0.7, 1.0, 0.0, 11.0, 10.0), (0, 4, 0, 0.6, 5.0, 0.0, 15.0, 10.0)]
SCHEMA = "frame_index bigint, prediction bigint, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"


def test_nms(spark):
    df = spark.createDataFrame(BOXES, SCHEMA)
    kept = lambda d: [r.prediction for r in d.orderBy("prediction").collect()]
    assert kept(D.nms(df)) == [1, 3, 4] and kept(D.nms(df, cap=2)) == [1, 3]
    assert kept(D.nms_arrow(df)) == [1, 3, 4] and kept(D.nms_arrow(df, cap=2)) == [1, 3]


def test_nms_is_conflict_free_and_maximal(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        x, y = rng.uniform(0, 60), rng.uniform(0, 60)
        rows.append((i % 3, i, rng.randrange(3), round(rng.random(), 2), x, y, x + rng.uniform(5, 30), y + rng.uniform(5, 30)))
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r.prediction for r in D.nms(df).collect()}
    assert kept == {r.prediction for r in D.nms_arrow(df).collect()}

    def iou(a, b):
        w, h = max(0, min(a[6], b[6]) - max(a[4], b[4])), max(0, min(a[7], b[7]) - max(a[5], b[5]))
        return w * h / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - w * h)

    for a in rows:
        better = [b for b in rows if b[1] in kept and b[0] == a[0] and b[2] == a[2] and (-b[3], b[1]) < (-a[3], a[1]) and iou(a, b) > 0.45]
        assert (a[1] in kept) == (not better)


def test_class_choice_and_shapes(spark):
    s = F.array(*map(F.lit, (0.9, 0.2, 0.5)))
    assert one(spark, D.best_class(s, [2, 1]).alias("b"))[0] == (2, 0.5)
    assert one(spark, D.best_class(F.array(F.lit(0.0), F.lit(-1.0))).alias("b"))[0] is None
    for dims, want in (([1, 25200, 85], (25200, False, 85, 5)), ([1, 85, 25200], (25200, True, 85, 5)), ([1, 84, 8400], (8400, True, 84, 4)), ([1, 25200, 90], None)):
        assert one(spark, D.output_shape(F.array(*map(F.lit, dims)), F.lit(80)).alias("s"))[0] == want
    assert one(spark, D.default_predictions(F.lit(640), F.lit(640)))[0] == 25200


PLAN = "frame_bytes bigint, raw_upload boolean, raw_download boolean, video_fps double, free_vram bigint, h2d_gbps double, d2h_gbps double"
FIXED = {"in_bytes": 4915200, "out_bytes": 8568000, "total_vram": 4 << 30, "vram_reserve_mb": 0, "cuda_available": True, "target_fps": 0.0, "vram_budget_ratio": 0.375, "auto_tune": True, "batch_size": 0, "inflight_batches": 0, "overlap_mode": "auto", "parallel_mode": "auto", "async_engines": 2, "concurrent_kernels": False, "parallel_contexts": True, "max_contexts": 3, "true_batch": False, "max_batch": 1, "manual_contexts": 0}


def test_plans(spark):
    rows = [(12441600, False, False, 60.0, 3 << 30, 10.0, 10.0), (1382400, True, False, 60.0, 3 << 30, 10.0, 10.0), (1382400, True, False, 240.0, 1 << 30, 1.0, 1.0)]
    df = spark.createDataFrame(rows, PLAN).withColumns({k: F.lit(v).cast("long") if k in ("in_bytes", "out_bytes", "total_vram") else F.lit(v) for k, v in FIXED.items()})
    got = {(r.per_frame_bytes, r.reserve_bytes, r.vram_budget_bytes, r.schedule_batch, r.estimated_bytes, r.inflight, r.unused_bytes) for r in C.plan(df).collect()}
    assert got == {(30119104, 858993459, 1610612736, 8, 257730048, 2, 1352882688), (19059904, 858993459, 1610612736, 8, 169256448, 2, 1441356288), (19059904, 858993459, 214748365, 1, 35837120, 2, 178911245)}
    lanes = C.async_override(C.plan(df.withColumn("concurrent_kernels", F.lit(True))), F.lit(2)).select("contexts", "execution_mode").collect()
    assert {r.contexts for r in lanes} == {2} and {r.execution_mode for r in lanes} == {3}


def test_reorder_wait_over_blocks(spark):
    df = spark.createDataFrame(list(enumerate([5, 3, 9, 4])), "frame_index bigint, done bigint")
    for block in (1, 2, 100):
        got = W.running(df, "done", "release", "max", block=block).orderBy("frame_index").collect()
        assert [r.release for r in got] == [5, 5, 9, 9]
    assert [r.wait for r in W.reorder_wait(df, "done").orderBy("frame_index").collect()] == [0, 2, 0, 5]


def test_report(spark):
    t = spark.createDataFrame([("cpu", 10.0), ("cpu", 20.0), ("cpu", 30.0), ("gpu", 20.0)], "mode string, total_ms double")
    r = {x["mode"]: x for x in T.matrix_report(t).collect()}
    assert (r["cpu"].frames, r["cpu"].total_time_ms, r["cpu"].average_ms_per_frame, r["cpu"].processed_fps, r["cpu"].speedup) == (3, 60.0, 20.0, 50.0, 3.0)


def test_stream_orders_any_arrival(spark, tmp_path):
    from reelspark.streaming import flows

    rng = random.Random(6)
    rows = [(s, i, 100 * s + i) for s in (0, 1) for i in range(60)]
    rng.shuffle(rows)
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], "stream_id int, frame_index bigint, payload bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("stream_id int, frame_index bigint, payload bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = flows.drained(spark, flows.in_order(stream), "ordered_test", "append").collect()
    for s in (0, 1):
        assert [r.frame_index for r in got if r.stream_id == s] == list(range(60))
    assert {tuple(r) for r in got} == set(rows)


def test_options():
    o = O.parse("--task detect --model M.ONNX --class-ids 0,2,2 --classes".split() + ["person,, traffic light", "--auto-tune", "--batch-size", "4", "--output-format", "mkv", "--output", "a.b/out"])
    assert (o.class_ids, o.classes, o.batch_size, o.inflight_batches, o.output) == ((0, 2), ("person", "traffic light"), 4, 0, "a.b/out.mkv")
    assert O.parse(["--input-size", "320"]).input_height == 320 and O.parse([]) == O.Options()
    for bad, text in ((["--nope"], "unknown option: --nope"), (["--model"], "missing value for --model"), (["--class-ids", "0,,2"], "invalid"), (["--confidence", "1.5"], "invalid"), (["--task", "detect", "--model", "x.weights"], "unsupported"), (["--task", "detect", "--model", "x.onnx", "--runtime", "tensorrt"], "selects onnxruntime")):
        with pytest.raises(O.OptionError, match=text):
            O.parse(bad)
    assert O.parse(["--task", "detect", "--model", "x.weights", "--list-backends"]).list_backends
    assert O.with_extension("out.mp4", "mkv") == "out.mkv" and O.runtime_of("M.ONNX") == "onnxruntime"
    again = O.parse(O.command("run", o)[1:] + ["--output-format", "mkv"])
    assert again == o and "runtime: auto" in O.summary(o)
    for name, base in itertools.product(O.PRESETS, (O.Options(),)):
        o = O.preset(base, name)
        assert o.task == "detect" and o.progress_interval == 60 and O.issues(o, lambda p: True) == [] and O.parse(O.command("run", o)[1:]) == o
    assert O.preset(O.Options(), "Custom") == O.Options()
    fast, safe, stress = (O.preset(O.Options(), n) for n in ("Fast Staged GPU Annotated Video", "Safe CPU Detection", "NVDEC/NVENC Stress Test"))
    assert (fast.model, fast.precision, fast.batch_size, fast.inflight_batches, fast.inference_contexts, fast.target_fps, fast.output) == ("models/yolov5s_trt11.engine", "fp16", 2, 3, 2, 60.0, "data/output/fast_gpu_annotated_video.mkv")
    assert (safe.backend_device, safe.max_frames, safe.runtime, safe.benchmark) == ("cpu", 120, "onnxruntime", "benchmarks/benchmarks/safe_cpu_detection_benchmark.csv") and (stress.decoder_fallback, stress.precision) == ("none", "fp32")
    assert O.issues(safe, lambda p: "." in p.rpartition("/")[2])[:2] == ["Input folder was not found.", "Output folder was not found."]
    assert O.encoder_of(O.Options(lossless=True)) == "libx264rgb" and O.encoder_of(O.Options(), frozenset({"mpeg4"})) == "mpeg4"
    with pytest.raises(O.OptionError):
        O.encoder_of(O.Options(lossless=True, encoder="mpeg4"))
    assert O.windows_quoted('a "b" c\\') == '"a \\"b\\" c\\\\"'


def test_text(spark):
    assert one(spark, *[X.duration(F.lit(float(s))) for s in (0, 65, 3661)]) == ("--", "1:05", "1:01:01")
    assert one(spark, X.byte_size(F.lit(1536)), X.byte_size(F.lit(10)), X.family_name(F.lit("my run.v1!"))) == ("1.50 KB", "10 B", "my_run_v1")
    assert one(spark, X.preview_quoted(F.lit('a "b"')), X.shape_text(F.array(F.lit(1), F.lit(2))), X.numeric_prefix(F.lit("12.5x"))) == ('"a \\"b\\""', "[1,2]", 12.5)
    line = "PROGRESS frame=5 total_frames=10 fps=2.5"
    r = X.parsed(spark.createDataFrame([(1, line), (2, "hardware detection pipeline: batch_capacity=4 x inflight_batches=2 inference_workers=3"), (3, "batch_size: 8 ")], "line_no int, text string")).orderBy("line_no").collect()
    assert r[0].kv["frame"] == "5" and r[1].hardware == [4, 2, 3] and (r[2].plan_key, r[2].plan_value) == ("batch_size", "8")


def test_limits_of_lists_and_strings(spark):
    many = ",".join(map(str, range(129)))
    ids = lambda t: one(spark, F.size(X.parse_ids(F.lit(t))))[0]
    names = lambda t: one(spark, F.size(X.parse_names(F.lit(t))))[0]
    assert ids(many[:-4]) == 128 and ids(many) is None and names("a," + "b" * 63) == 2 and names("a," + "b" * 64) is None and names(many) is None
    assert one(spark, X.bounded(F.lit("abc"), 4), X.bounded(F.lit("abcd"), 4), X.truncated(F.lit("abcd"), 4), X.mib(F.lit(3 << 20))) == ("abc", "", "abc", 3.0)
    assert [one(spark, X.element_size(F.lit(t)))[0] for t in ("fp32", "fp16", "int32", "int8", "bool", "x")] == [4, 2, 4, 1, 1, 0]


def test_recognising_detection_tensors():
    t = lambda *d: np.zeros(d)
    assert D.first_detections([t(3), (t(2, 4), [t(1, 7, 85)])]).shape == (1, 7, 85) and D.first_detections((t(4097, 3), [])) is None
    assert D.first_detections([[[[[t(1, 9, 9)]]]]]) is None and D.first_detections(t(84, 3)).shape == (84, 3)


def test_output_layouts(spark):
    rows = [[float(10 * p + a) for a in range(7)] for p in range(3)]
    flat, turned = sum(rows, []), [r[a] for a in range(7) for r in rows]
    df = spark.createDataFrame([(0, [1, 3, 7], flat), (1, [1, 7, 3], turned)], "frame_index bigint, dims array<int>, output array<float>")
    got = D.read_outputs(df, 2).orderBy("frame_index", "prediction").collect()
    assert [tuple(r)[1:] for r in got[:3]] == [tuple(r)[1:] for r in got[3:]] and got[1].obj == 14.0 and got[1].scores == [15.0, 16.0]
    assert {r.obj for r in D.read_outputs(df, 3).collect()} == {1.0}  # 4 + 3 attributes: no objectness of its own
    with pytest.raises(Exception, match="no detections in a tensor of 1x"):
        D.read_outputs(df, 9).collect()
    assert one(spark, D.output_shape(F.array(F.lit(-1), F.lit(85)), F.lit(80)).alias("s"))[0] is None


def test_bounded_lists_do_not_lose_detections(spark):
    df = spark.createDataFrame(BOXES, SCHEMA)
    (r,) = D.bounded_lists(df, cap=4).collect()
    assert [d.prediction for d in r.detections] == [1, 2, 3, 4]
    with pytest.raises(Exception, match="more than 3"):
        D.bounded_lists(df, cap=3).collect()


def test_formats_and_half_precision(spark):
    from reelspark.operators import backends as B

    a = np.array([[[[255, 0, 0], [255, 0, 0]], [[255, 0, 0], [255, 0, 0]]]], np.uint8)
    assert P.converted(a, "gray8").tolist() == [[76] * 4] and P.converted(a, "nv12").tolist() == [[76, 76, 76, 76, 85, 255]] and P.converted(a, "rgb24").size == 12
    with pytest.raises(ValueError):
        P.converted(a[:, :, :1], "nv12")
    df = spark.createDataFrame([(0, list(range(48)))], "frame_index bigint, px array<int>")
    full, half = (B.infer(P.preprocess_arrays(df, 8, 4, 16, 16, bilinear=True, half=h), "stand-in", None, 16, 16, half=h).first() for h in (False, True))
    assert full.dims == half.dims == [1, 4, 8] and full.output != half.output and full.output == pytest.approx(half.output, abs=1e-3)
    with pytest.raises(Exception, match="not available"):
        B.infer(P.preprocess_arrays(df, 8, 4, 16, 16, bilinear=True), "tensorrt", None, 16, 16).collect()


def test_lanes_take_frames_as_they_get_free():
    assert W.greedy_lanes([3.0, 1.0, 1.0, 5.0, 1.0], 2) == [0, 1, 1, 1, 0]


def test_containers_and_sources(spark):
    df = spark.createDataFrame([(0, 10, 1, 25, 30000, 1001), (0, None, 1, 25, None, 1), (1, 3, 1, 0, 25, 1)], "stream_index int, pts long, tb_num int, tb_den int, rate_num int, rate_den int")
    rows = S.stamps(W.of_stream(df, 0)).orderBy("timestamp_ms").collect()
    assert [r.timestamp_ms for r in rows] == [0.0, 400.0] and rows[0].fps == 30.0 and rows[1].fps == pytest.approx(29.97, abs=0.001) and S.stamps(W.of_stream(df, 1)).first().timestamp_ms == 0.0
    info = S.source_info(640, 480, 0, spark.range(60)).first()
    assert (info.fps, info.total_frames, info.duration_sec) == (30.0, 60, 2.0)
    lines = C.hardware_lines(spark.createDataFrame([("x", 4 << 30, 3 << 30, 2, True, 10.0, 9.5)], "name string, total_vram bigint, free_vram bigint, async_engines int, concurrent_kernels boolean, h2d_gbps double, d2h_gbps double")).first().lines
    assert lines == ["total_vram: 4.00 GiB", "free_vram: 3.00 GiB", "async_engines: 2", "concurrent_kernels: yes", "copy GB/s: 10.00 / 9.50"]


def test_files_of_a_run(spark, tmp_path):
    from reelspark.sources import sinks

    det = spark.createDataFrame([(3, 120.0, 1, 0.75, 1.0, 2.0, 3.0, 4.0), (0, 0.0, 7, 0.5, 0.0, 0.0, 1.0, 1.0)], "frame_index bigint, timestamp_ms double, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    sinks.write_detections(det, spark.createDataFrame([(1, "car")], "class_id int, class_name string"), f"{tmp_path}/det")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/det").collect()]
    assert "3,120.000000,1,car,0.750000,1.000,2.000,3.000,4.000" in lines and any(x.startswith("0,0.000000,7,") for x in lines)
    sinks.write_log(spark.createDataFrame([(1, "a"), (0, "b\r")], "line_no long, text string"), f"{tmp_path}/log")
    assert sorted(r.text for r in S.read_log(spark, f"{tmp_path}/log").collect()) == ["a", "b"]
    for name in ("B.MP4", "a.mkv", "x.txt", "m.onnx", "n.engine", "k.pt"):
        (tmp_path / name).write_bytes(b"1")
    assert [r.file for r in S.listing(spark, str(tmp_path)).collect()] == ["B.MP4", "a.mkv"]
    assert [r.file for r in S.models(spark, str(tmp_path), "torchscript").collect()] == ["k.pt"] and [r.file for r in S.models(spark, str(tmp_path)).collect()] == ["k.pt", "m.onnx", "n.engine"]
    assert S.model_bytes(spark, f"{tmp_path}/m.onnx") == b"1"
    (tmp_path / "r.csv").write_text('frame_index,total_ms\n0,"1"\n1,2.5x\n2,\n3,4')
    assert sorted(r.value for r in S.read_report(spark, f"{tmp_path}/r.csv").collect()) == [2.5, 4.0]
    with pytest.raises(ValueError, match="no column"):
        S.read_report(spark, f"{tmp_path}/r.csv", "nope")


def test_live_progress_and_stream_sums(spark, tmp_path):
    from reelspark.streaming import flows

    spark.createDataFrame([(i, f"progress: completed {i + 1} frames, wall_clock_fps=2.5") for i in range(9)], "line_no long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("line_no long, text string").parquet(f"{tmp_path}/in")
    assert tuple(flows.drained(spark, flows.live_progress(stream), "live-test", "complete").first()) == (9, 2.5, 8)


def test_raw_frames_and_labels(spark, tmp_path):
    S.register(spark)
    rng = random.Random(3)
    rows = [(i, 4, 2, bytes(rng.randrange(256) for _ in range(24))) for i in range(100)]
    df = spark.createDataFrame(rows, "frame_index bigint, width int, height int, data binary")
    full = df.selectExpr("'v' as video", "frame_index", "width", "height", "'rgb24' as format", "0.0D as timestamp_ms", "data")
    full.coalesce(1).write.format("rawframes").option("path", f"{tmp_path}/raw").mode("append").save()
    back = spark.read.format("rawframes").option("path", f"{tmp_path}/raw").option("width", 4).option("height", 2).option("fps", 25).load()
    got = back.orderBy("frame_index").collect()
    assert [bytes(r.data) for r in got] == [r[3] for r in rows] and got[50].timestamp_ms == 2000.0
    assert spark.read.format("rawframes").option("path", f"{tmp_path}/raw").option("width", 4).option("height", 2).option("max_frames", 7).load().count() == 7
    shift = full.withColumn("frame_index", F.col("frame_index") + 100)  # a second append adds to the first
    shift.coalesce(1).write.format("rawframes").option("path", f"file://{tmp_path}/raw").mode("append").save()
    assert spark.read.format("rawframes").option("path", f"file://{tmp_path}/raw").option("width", 4).option("height", 2).load().count() == 200
    blurred = P.filter_frames(back, "blur3x3").orderBy("frame_index").first()
    assert bytes(blurred.data) == P.blur_frames(np.frombuffer(rows[0][3], np.uint8).reshape(1, 2, 4, 3), 3).tobytes()
    (tmp_path / "labels.txt").write_text("  person \n\ncar\r\n  \nbus")
    assert [tuple(r) for r in S.read_labels(spark, f"{tmp_path}/labels.txt").orderBy("class_id").collect()] == [(0, "person"), (1, "car"), (2, "bus")]
    assert S.read_labels(spark, f"{tmp_path}/labels.txt", left=False).orderBy("class_id").first().class_name == "  person"
    assert S.read_labels(spark, f"{tmp_path}/none.txt").count() == 0
