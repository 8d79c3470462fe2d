"""Further registered queries: whole reports, model outputs, formats, listings and the state of a run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import views as V
from .functions import text as X
from .operators import dataflow as W
from .operators import detect as D
from .operators import pixels as P
from .operators import telemetry as T
from .plans import planner as C
from .registry import _DIM_SQL, _MODEL_SQL, _MODELS, _RGB, _YUV, ORACLES, _dims, _grid, _nms_sql, _pixels, _planes, _rounded, _streamed, query
from .sources.sinks import DETECTION_COLUMNS, report_rows
from .views import with_views

# ---- reports over frames, detections and timings

#: stages as binary fractions of the decoding time, so that sums are exact in any order
_STAGES = {"upload_ms": 0.125, "preprocess_ms": 0.25, "inference_ms": 0.5, "download_ms": 0.0625, "postprocess_ms": 0.125, "overlay_ms": 0.0625, "encode_ms": 0.25, "mux_write_ms": 0.0625}
_TIMED = "ft as (select frame_index, timestamp_ms, decode_ms, " + ", ".join(f"decode_ms * {x}::double as {c}" for c, x in _STAGES.items()) + f", decode_ms * {1.125 + 1 + 0.25 + 0.0625}::double as total_ms from fr)"


def _timed(spark, sf):
    f = V.frames(spark, sf)
    t = f.select("frame_index", "timestamp_ms", "decode_ms", *[(F.col("decode_ms") * x).alias(c) for c, x in _STAGES.items()])
    return T.with_totals(t, "cuda_detect")


def _found(spark, sf):
    return D.nms(D.decode(V.predictions(spark, sf)))


_PLAN_SQL = f"(select * from ({ORACLES['q42_execution_plan']}) where n = 1) pl, (select distinct vram_budget_bytes as budget from ({ORACLES['q41_plan_candidates']}) where n = 1) bu"
_PLAN_TEXT = {
    "schedule_batch_size": "schedule_batch", "backend_batch_size": "backend_batch", "batch_size": "schedule_batch", "inflight_batches": "inflight", "total_active_frames": "active_frames", "active_frame_capacity": "active_frames",
    "frames_per_upload_batch": "0", "frames_per_download_batch": "0", "execution_mode": "execution_mode", "inference_context_count": "contexts", "inference_lane_count": "contexts",
}
_META_TEXT = {
    "runtime_backend": "onnxruntime", "model_format": "onnx", "model_adapter": "yolov5", "backend_device": "cuda", "input_layout": "nchw", "input_dtype": "fp16", "output_device": "metadata_host", "precision": "fp16",
    "video_width": "3840", "video_height": "2160", "video_fps": "60.000000", "frame_bytes": "12441600", "raw_frame_upload_bytes": "0", "raw_frame_download_bytes": "0",
}


def _report_cell(c: str) -> str:
    mb = {"vram_budget_mb": "budget", "estimated_batch_mb": "estimated_bytes", "unused_vram_budget_mb": "unused_bytes"}
    if c in _META_TEXT:
        return f"'{_META_TEXT[c]}' as {c}"
    if c in _PLAN_TEXT:
        return f"({_PLAN_TEXT[c]})::varchar as {c}"
    if c in mb:
        return f"printf('%.6f', {mb[c]} / 1048576.0::double) as {c}"
    if c in (*_STAGES, "decode_ms", "total_ms"):
        return f"printf('%.6f', {c}) as {c}"
    special = {"frame_index": "ft.frame_index::varchar", "backend_inference_ms": "printf('%.6f', inference_ms)", "detections_count": "coalesce(cn.n, 0)::varchar", "metadata_download_bytes": "(coalesce(cn.n, 0) * 40)::varchar"}
    return f"{special[c]} as {c}" if c in special else f"'0.000000' as {c}"


@query(with_views("pred", "frames", then=_nms_sql(300) + f", {_TIMED}, cn as (select frame_index, count(*) as n from det group by 1)", recursive=True) + "select " + ", ".join(map(_report_cell, DETECTION_COLUMNS)) + f" from ft left join cn on ft.frame_index = cn.frame_index, {_PLAN_SQL}")
def q64_detection_report(spark, sf):
    """The detection report in full: frames, their detections and durations, with the run's plan and metadata."""
    t = T.frame_report(_timed(spark, sf), _found(spark, sf))
    t = T.with_plan(t, C.plan(_grid(spark).filter("n = 1")))
    t = T.with_detection_metadata(t, model="models/yolov5s.onnx", width=3840, height=2160, fps=60.0, raw_upload=False, raw_download=False)
    return report_rows(t.drop("process_ms"), DETECTION_COLUMNS)


@query(with_views("pred", "frames", then=_nms_sql(300) + f", {_TIMED}", recursive=True) + "select det.frame_index, prediction, class_id, timestamp_ms, round(confidence, 6) as confidence, round(inference_ms, 6) as inference_ms, round(total_ms, 6) as total_ms from det join ft on det.frame_index = ft.frame_index")
def q65_detections_with_timings(spark, sf):
    t = _timed(spark, sf)
    rows = T.detection_rows(t, _found(spark, sf), t.select("frame_index", "inference_ms", "total_ms"))
    return rows.select("frame_index", "prediction", "class_id", "timestamp_ms", *[F.round(c, 6).alias(c) for c in ("confidence", "inference_ms", "total_ms")])


_AT = "case vec_id % 3 when 0 then o[1 + p * 21 + {a}] else o[1 + ({a}) * 3 + p] end"


@query("with e as (select vec_id, list_transform(embedding, lambda x: (x::double + 0.5)::float::double) as o, unnest(range(3))::int as p from embeddings), "
       + "r as (select *, [" + ", ".join("case vec_id % 3 when 2 then " + f"o[1 + {4 + c} * 3 + p]" + f" when 1 then o[1 + {5 + c} * 3 + p] else o[1 + p * 21 + {5 + c}] end" for c in range(16)) + "] as scores from e) "
       + "select vec_id as frame_index, p as prediction, " + ", ".join(f"round({_AT.format(a=k)}, 6) as {c}" for k, c in enumerate(("cx", "cy", "w", "h"))) + f", round(case vec_id % 3 when 2 then 1.0::double else {_AT.format(a=4)} end, 6) as obj, round(list_max(scores), 6) as top, (list_position(scores, list_max(scores)) - 1)::int as class_id from r")
def q66_output_layouts(spark, sf):
    """Tensors in all three layouts: by prediction, by attribute, and by attribute without an objectness."""
    e, k = V.table(spark, sf, "embeddings"), F.col("vec_id") % 3
    shape = lambda *d: F.array(*map(F.lit, d))
    outputs = e.select(F.col("vec_id").alias("frame_index"), F.when(k == 0, shape(1, 3, 21)).when(k == 1, shape(1, 21, 3)).otherwise(shape(1, 20, 3)).alias("dims"), F.expr("transform(embedding, v -> cast(cast(v as double) + 0.5D as float))").alias("output"))
    p = D.read_outputs(outputs, 16).withColumn("b", D.best_class(F.col("scores")))
    top = F.array_max("scores")
    return p.select("frame_index", "prediction", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h", "obj")], F.round(top, 6).alias("top"), (F.array_position("scores", top) - 1).cast("int").alias("class_id"))


# ---- formats


@query(with_views("px", then=_RGB + """, y as (select frame_index, q as i, trunc(0.299::double * r + 0.587::double * g + 0.114::double * b + 0.5)::int as p from rgb),
m as (select frame_index, (q // 8) * 2 + (q % 4) // 2 as k, sum(r) / 4.0::double as r, sum(g) / 4.0::double as g, sum(b) / 4.0::double as b from rgb group by 1, 2)""") + """
select frame_index, i::int as i, p from y union all
select frame_index, (16 + k * 2)::int, least(greatest(floor(128 - 0.168736::double * r - 0.331264::double * g + 0.5::double * b + 0.5), 0), 255)::int from m union all
select frame_index, (17 + k * 2)::int, least(greatest(floor(128 + 0.5::double * r - 0.418688::double * g - 0.081312::double * b + 0.5), 0), 255)::int from m""")
def q67_rgb_to_nv12(spark, sf):
    return _pixels(P.convert_arrays(V.rgb24(spark, sf), "nv12", 4, 4))


def _half(x: str) -> str:
    e = f"greatest(floor(log2({x}))::int, -14)"
    return f"case when {x} > 0 then round_even({x} * pow(2.0, 10 - {e}), 0) / pow(2.0, 10 - {e}) else 0.0 end"


_BILINEAR = ORACLES["q37_preprocess_bilinear"].split("select frame_index, x, y, round(r, 6)")[0].rstrip()


@query(_BILINEAR + f""", w as (select frame_index, x, y, r, g, b from (select frame_index, x, y, {_YUV} from q) union all select frame_index, x, y, 114.0::double / 255, 114.0::double / 255, 114.0::double / 255 from s where not (sx >= 0 and sy >= 0 and sx <= 7 and sy <= 3))
select frame_index, x, y, """ + ", ".join(f"round({_half(c)}, 6) as {c}" for c in "rgb") + " from w")
def q68_preprocess_half(spark, sf):
    return _planes(P.preprocess_arrays(V.nv12(spark, sf), 8, 4, 16, 16, bilinear=True, half=True), 16)


@query(f"with {_DIM_SQL}, e as (select *, (case f when 'rgb24' then 3 * w else w end)::bigint as stride, (case f when 'rgb24' then 3 * w * h when 'nv12' then w * h * 3 // 2 else w * h end)::bigint as size from d) select w, h, f, size > 0 and w > 0 and h > 0 and f <> 'yuv' and not (f = 'nv12' and (w % 2 = 1 or h % 2 = 1)) as valid from e")
def q69_frame_validity(spark, sf):
    w, h, f = F.col("w"), F.col("h"), F.col("f")
    stride, size = F.when(f == "rgb24", 3 * w).otherwise(w), F.when(f == "rgb24", 3 * w * h).when(f == "nv12", F.floor(w * h * 3 / 2)).otherwise(w * h)
    return _dims(spark).select(w, h, f, P.valid_frame(w, h, f, stride, size).alias("valid"))


# ---- listings and rules

_YES = "case when {} then 'yes' else 'no' end"
_LISTED = ["'compiled: ' || " + _YES.format("compiled"), "'available: ' || " + _YES.format("compiled"), "'cuda: ' || " + _YES.format("cuda_available"), "'cpu: ' || " + _YES.format("cpu_available"), "'gpu_io: ' || " + _YES.format("gpu_io_available"), "'true_batch: ' || " + _YES.format("true_batch"), "'multi_context: ' || " + _YES.format("multi_context"), "'version: ' || version"]


@query(f"select runtime, runtime || ':|  ' || {' || chr(124) || chr(32) || chr(32) || '.join(_LISTED)} as listing from ({ORACLES['q58_backend_registry']})")
def q70_backend_listing(spark, sf):
    return C.backend_lines(C.registry(spark, compiled=("onnxruntime",))).select("runtime", F.array_join("lines", "|").alias("listing"))


@query(f"""with {_MODEL_SQL}, r as (select * from (values ('auto'), ('tensorrt'), ('onnxruntime')) t(asked)), a as (select path, asked, runtime as found, case when asked = 'auto' then runtime else asked end as sel from k, r)
select path, asked, case when path = '' or found = 'auto' or (asked <> 'auto' and asked <> found) then 'no' else 'yes' end as valid,
  case when path = '' or found = 'auto' or (asked <> 'auto' and asked <> found) then null when sel = 'onnxruntime' then 'yes' else 'no' end as compiled, case sel when 'torchscript' then 'libtorch' else sel end as backend from a""")
def q71_model_info(spark, sf):
    m = spark.createDataFrame([(m, r, "cuda", "coco.names") for m in _MODELS for r in ("auto", "tensorrt", "onnxruntime")], "path string, asked string, device string, labels string")
    info = C.model_info(m, C.registry(spark, compiled=("onnxruntime",)))
    value = lambda k: F.try_element_at(F.transform(F.filter("lines", lambda x: x.startswith(f"  {k}: ")), lambda x: F.substring(x, len(k) + 5, 200)), F.lit(1))
    return info.select("path", "asked", value("valid").alias("valid"), value("backend_compiled").alias("compiled"), value("backend").alias("backend"))


@query("""with d as (select * from (values ('cpu'), ('nvdec')) a(decoder), (values ('cuda'), ('cpu')) b(device), (values (true), (false)) c(draw), (values ('cpu'), ('none')) e(fallback), (values (true), (false)) f(ok))
select *, case when decoder = 'cpu' then 'cpu' when ok then 'hardware' when fallback = 'none' or (device = 'cuda' and draw) then 'failed' else 'cpu_fallback' end as path, decoder = 'nvdec' and not ok and fallback = 'cpu' as told from d""")
def q72_decoder_fallback(spark, sf):
    df = spark.range(1)
    for name, values in (("decoder", ("cpu", "nvdec")), ("backend_device", ("cuda", "cpu")), ("draw_boxes", (True, False)), ("decoder_fallback", ("cpu", "none")), ("hardware_ok", (True, False))):
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    out = C.decoder_fallback(df)
    return out.select("decoder", F.col("backend_device").alias("device"), F.col("draw_boxes").alias("draw"), F.col("decoder_fallback").alias("fallback"), F.col("hardware_ok").alias("ok"), "path", (F.col("message") != "").alias("told"))


@query(f"""with q as ({ORACLES['q42_execution_plan']}) select n, greatest(least(contexts, inflight), 1)::int as workers, contexts > 2 and parallel = 'on' as context_error, (case when contexts > 2 then 1 else contexts end)::int as contexts
from (select q.*, case (q.n - 1) % 6 when 1 then 'on' when 2 then 'auto' when 3 then 'off' when 5 then 'on' else 'auto' end as parallel from q)""")
def q73_plan_overrides(spark, sf):
    """Workers of the blocking path, and what an engine with two contexts makes of a plan."""
    p = C.blocking_override(C.plan(_grid(spark)))
    return C.apply_contexts(p, F.lit(2)).select("n", "workers", "context_error", "contexts")


# ---- logs

_RUN_LOG = """rl as (select event_id as line_no, case when event_id % 97 = 5 then 'Hardware detection pipeline: decoder batch_capacity=' || (event_id % 7 + 1) || ' inflight_batches=' || (event_id % 3 + 1) || ' inference_workers=' || (event_id % 2 + 1)
  when event_id % 70 = 9 then 'batch_size: ' || (event_id % 8 + 1) when event_id % 5 = 2 then 'PROGRESS frame=' || event_id || ' total_frames=5000 timestamp_ms=' || event_id * 40 || '.5 fps=' || printf('%.2f', value) || ' detections=' || event_id * 2 || ' junk'
  else 'Progress:   Completed ' || (event_id + 1) || ' frames wall_clock_fps=' || printf('%.2f', value) end as text from events)"""


def _run_log(spark, sf):
    n, s = F.col("event_id"), lambda c: c.cast("string")
    text = (
        F.when(n % 97 == 5, F.concat(F.lit("Hardware detection pipeline: decoder batch_capacity="), s(n % 7 + 1), F.lit(" inflight_batches="), s(n % 3 + 1), F.lit(" inference_workers="), s(n % 2 + 1)))
        .when(n % 70 == 9, F.concat(F.lit("batch_size: "), s(n % 8 + 1)))
        .when(n % 5 == 2, F.concat(F.lit("PROGRESS frame="), s(n), F.lit(" total_frames=5000 timestamp_ms="), s(n * 40), F.lit(".5 fps="), F.format_string("%.2f", "value"), F.lit(" detections="), s(n * 2), F.lit(" junk")))
        .otherwise(F.concat(F.lit("Progress:   Completed "), s(n + 1), F.lit(" frames wall_clock_fps="), F.format_string("%.2f", "value")))
    )
    return V.table(spark, sf, "events").select(n.alias("line_no"), text.alias("text"), F.lit(False).alias("is_error"))


_KV = "nullif(regexp_extract(text, '^PROGRESS .*\\b{k}=([0-9.]+)', 1), '')"


@query(f"""with {_RUN_LOG}, p as (select line_no, text, coalesce({_KV.format(k='frame')}::int, nullif(regexp_extract(text, 'Completed ([0-9]+)', 1), '')::int) as frames, {_KV.format(k='total_frames')}::int as total, {_KV.format(k='timestamp_ms')}::double as ts,
  coalesce({_KV.format(k='fps')}::double, nullif(regexp_extract(text, 'wall_clock_fps=([0-9.]+)', 1), '')::double) as fps, {_KV.format(k='detections')}::int as det, nullif(regexp_extract(text, 'batch_capacity=([0-9]+)', 1), '')::int as cap, nullif(regexp_extract(text, 'inflight_batches=([0-9]+)', 1), '')::int as fl,
  nullif(regexp_extract(text, 'inference_workers=([0-9]+)', 1), '')::int as wk, nullif(regexp_extract(text, '^batch_size: ([0-9]+)', 1), '')::int as bs from rl),
l as (select arg_max(text, line_no) as last_line, arg_max(frames, line_no) as frames, arg_max(total, line_no) as total, arg_max(ts, line_no) as ts, arg_max(fps, line_no) as fps, arg_max(det, line_no) as det, arg_max(coalesce(bs, cap), line_no) as bs, arg_max(cap, line_no) as cap, arg_max(fl, line_no) as fl, arg_max(wk, line_no) as wk from p)
select last_line, frames as frames_processed, total as total_frames, ts as timestamp_ms, fps, det as total_detections, bs as batch_size, cap as schedule_batch_size, fl as inflight_batches, wk as inference_lane_count, cap * fl as total_active_frames, fl > 1 or wk > 1 as pipeline_overlap_enabled,
  wk > 1 as parallel_inference_enabled, least(frames::double / total, 1.0) as progress from l""")
def q74_progress_state(spark, sf):
    return X.progress_state(_run_log(spark, sf)).select(
        "last_line", "frames_processed", "total_frames", "timestamp_ms", "fps", "total_detections", "batch_size", "schedule_batch_size", "inflight_batches", "inference_lane_count", "total_active_frames",
        "pipeline_overlap_enabled", "parallel_inference_enabled", "progress",
    )


@query(with_views("logs") + "select line_no, text from lg where text like '%1%' and not (is_error or lower(text) like '%error%' or lower(text) like '%failed%') and lower(text) not like '%warn%'")
def q75_log_filter(spark, sf):
    return X.visible(V.logs(spark, sf), text="1", errors=False, warnings=False).select("line_no", "text")


# ---- order, lists, copies


@query("select (event_id % 4)::int as stream_id, event_id // 32 as frame_index, user_id as payload from events where (event_id // 4) % 8 = 0")
def q76_stream_batches_in_order(spark, sf):
    from .streaming import flows

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = _streamed(spark, sf, [(F.col("event_id") % 4).cast("int").alias("stream_id"), F.floor(F.col("event_id") / 4).alias("frame_index"), F.col("user_id").alias("payload")]).filter("frame_index % 8 = 0")
    return flows.drained(spark, flows.batches_in_order(s, 8), f"batches-{uuid.uuid4().hex}", "append")


@query(with_views("frames") + "select frame_index, row_number() over (order by frame_index) - 1 as pts from fr where frame_index % 3 <> 1")
def q77_encoder_pts(spark, sf):
    return W.with_pts(V.frames(spark, sf).filter("frame_index % 3 <> 1").select("frame_index"), block=1000)


@query(with_views("pred", then=_nms_sql(300), recursive=True) + "select frame_index, count(*)::int as detections, round(max(confidence), 6) as best from det group by 1")
def q78_bounded_lists(spark, sf):
    return D.bounded_lists(_found(spark, sf)).select("frame_index", F.size("detections").alias("detections"), F.round(F.get("detections", F.lit(0))["confidence"], 6).alias("best"))


@query(ORACLES["q25_nms"])
def q79_nms_by_frame(spark, sf):
    """The same suppression with numpy, for frames of many thousand candidates."""
    return _rounded(D.nms_arrow(D.decode(V.predictions(spark, sf))))


@query(with_views("frames", then="c as (select event_type, decode_ms as ms, (case frame_index % 3 when 0 then 16 when 1 then 64 else 128 end)::bigint * 1048576 as bytes from fr)") + "select event_type, round(avg(bytes / ms / 1e6::double), 6) as gbps from c where ms > 0 group by event_type")
def q80_copy_bandwidth(spark, sf):
    k = F.col("frame_index") % 3
    c = V.frames(spark, sf).select("event_type", F.col("decode_ms").alias("ms"), (F.when(k == 0, 16).when(k == 1, 64).otherwise(128).cast("long") * 1048576).alias("bytes"))
    return T.copy_bandwidth(c, "event_type")


@query(with_views("frames", then="m as (select frame_index, (decode_us % 9000) * 1000 as before, (frame_index % 7) * 1000000 as after from fr)") + "select frame_index, greatest(before - after, 0)::bigint as engine_bytes, greatest(before - after, 0) / 1048576.0::double as engine_mib from m")
def q81_engine_memory(spark, sf):
    n = T.engine_memory(F.col("decode_us") % 9000 * 1000, F.col("frame_index") % 7 * 1000000)
    return V.frames(spark, sf).select("frame_index", n.alias("engine_bytes"), X.mib(n).alias("engine_mib"))


@query("with l as (select doc_id, coalesce(text, '') as t from documents) select doc_id, case when strlen(t) < 1024 then t else '' end as path, substr(t, 1, 63) as name from l")
def q82_bounded_text(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return V.table(spark, sf, "documents").select("doc_id", X.bounded(t, 1024).alias("path"), X.truncated(t, 64).alias("name"))
