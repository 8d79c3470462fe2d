"""All registered queries of the frame-stream operators, and their SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as V
from .functions import text as X
from .operators import dataflow as W
from .operators import detect as D
from .operators import pixels as P
from .operators import telemetry as T
from .plans import planner as C
from .storage import shared_folder
from .views import with_views

QUERIES = {}
ORACLES = {}
FLAGSHIP = "q27_detection_pipeline"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- telemetry


def total_sql(path: str) -> str:
    process, total = T.PATHS[path]
    return f"select *, {total.replace('process_ms', '(' + process + ')')} as total_ms, {process} as process from tm"


@query(with_views("timing", then=f"t as ({total_sql('filter')}), m as (select mode, count(*) as frames, sum(total_ms) as t from t group by mode)") + """
select mode, frames, round(t, 3) as total_time_ms, round(t / frames, 6) as average_ms_per_frame, round(frames * 1000.0 / t, 6) as processed_fps,
       round((select sum(t) from m where mode = 'cpu') / (select sum(t) from m where mode = 'gpu'), 6) as speedup from m""")
def q01_matrix_report(spark, sf):
    return T.matrix_report(T.with_totals(V.timing(spark, sf), "filter"))


@query(with_views("timing", then=f"t as ({total_sql('filter')})") + """
select count(*) as frames, round(sum(total_ms), 3) as total_ms, round(sum(total_ms) / count(*), 6) as avg_total_ms, round(sum(process) / count(*), 6) as avg_process_ms,
       round(count(*) * 1000.0 / sum(total_ms), 6) as processed_fps, round(count(*) * 1000.0 / 60000, 6) as wall_clock_fps from t""")
def q02_filter_summary(spark, sf):
    return T.filter_summary(T.with_totals(V.timing(spark, sf), "filter"), wall_ms=60000)


@query(with_views("timing", then=f"t as ({total_sql('cuda_detect')})") + "select runtime, count(*) as frames, round(count(*) * 1000.0 / 60000, 6) as wall_clock_fps, " + ", ".join(f"round(sum({'process' if c == 'process_ms' else c}) / count(*), 6) as avg_{c}" for c in T.SUMMED)
       + ", round(sum(total_ms) / count(*), 6) as avg_stage_sum_ms, round(count(*) * 1000.0 / sum(total_ms), 6) as latency_equivalent_fps from t group by runtime")
def q03_detection_summary_by_runtime(spark, sf):
    return T.detection_summary(T.with_totals(V.timing(spark, sf), "cuda_detect"), "runtime", wall_ms=60000)


def _totals(path):
    sql = with_views("timing", then=f"t as ({total_sql(path)})") + "select mode, runtime, count(*) as frames, round(sum(process), 3) as process_ms, round(sum(total_ms), 3) as total_ms, round(max(total_ms), 6) as slowest_ms from t group by mode, runtime"

    def run(spark, sf):
        t = T.with_totals(V.timing(spark, sf), path)
        return t.groupBy("mode", "runtime").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("process_ms"), 3).alias("process_ms"), F.round(F.sum("total_ms"), 3).alias("total_ms"), F.round(F.max("total_ms"), 6).alias("slowest_ms"))

    return sql, run


for _name, _path in (("q04_total_ms_filter_path", "filter"), ("q05_total_ms_cpu_detect", "cpu_detect"), ("q06_total_ms_cuda_detect", "cuda_detect")):
    ORACLES[_name], QUERIES[_name] = _totals(_path)

# ---- frames in order


@query(with_views("frames") + """select frame_index, frame_index * 1000.0::double / 25 as at_25_fps, case when decode_ms > 50 then decode_ms else frame_index * 1000.0::double / 25 end as container_ms, 0.0::double as without_fps from fr""")
def q07_frame_timestamps(spark, sf):
    i, c = F.col("frame_index"), F.when(F.col("decode_ms") > 50, F.col("decode_ms")).otherwise(F.lit(0.0))
    return V.frames(spark, sf).select(i, W.timestamp_ms(i, F.lit(25.0)).alias("at_25_fps"), W.timestamp_ms(i, F.lit(25.0), c).alias("container_ms"), W.timestamp_ms(i, F.lit(0.0)).alias("without_fps"))


@query(with_views("frames") + "select frame_index, timestamp_ms, decode_ms from fr where frame_index < 100")
def q08_limit_frames(spark, sf, max_frames: int = 100):
    return V.frames(spark, sf).filter(F.col("frame_index") < max_frames).select("frame_index", "timestamp_ms", "decode_ms")


@query(with_views("frames") + "select min(frame_index) as first_frame, max(frame_index) as last_frame, count(*) as frames, count(distinct frame_index) as distinct_frames, min(frame_index) = 0 and max(frame_index) + 1 = count(*) and count(*) = count(distinct frame_index) as gap_free from fr")
def q09_ordered_frames_gap_check(spark, sf):
    return W.gap_check(V.frames(spark, sf))


@query(with_views("frames") + "select frame_index, frame_index // 8 as batch_id, frame_index % 8 as slot, count(*) over (partition by frame_index // 8) as valid_frames from fr")
def q10_batch_numbering(spark, sf):
    return W.batches(V.frames(spark, sf), 8).select("frame_index", "batch_id", "slot", "valid_frames")


@query(with_views("frames") + "select frame_index % 3 as lane, count(*) as frames, sum(decode_us)::bigint as decode_us from fr group by 1")
def q11_lane_assignment(spark, sf):
    return V.frames(spark, sf).groupBy((F.col("frame_index") % 3).alias("lane")).agg(F.count(F.lit(1)).alias("frames"), F.sum("decode_us").alias("decode_us"))


@query(with_views("frames", then="d as (select frame_index, ts_us + floor(decode_ms * 1000000)::bigint as done_us from fr), r as (select *, max(done_us) over (order by frame_index) as release_us from d)") + "select *, release_us - done_us as wait_us from r")
def q12_reorder_wait(spark, sf):
    f = V.frames(spark, sf).select("frame_index", (F.col("ts_us") + F.floor(F.col("decode_ms") * 1000000)).cast("long").alias("done_us"))
    return W.reorder_wait(f, "done_us").select("frame_index", "done_us", F.col("release").alias("release_us"), F.col("wait").alias("wait_us"))


@query(with_views("frames", then="s as (select frame_index, sum(decode_us) over (order by frame_index)::bigint as elapsed_us from fr)") + "select frame_index, frame_index + 1 as completed, elapsed_us, round((frame_index + 1) * 1000000.0::double / elapsed_us, 6) as fps from s where (frame_index + 1) % 100 = 0")
def q13_progress_rows(spark, sf):
    return W.progress(V.frames(spark, sf), "decode_us", 100)


@query(with_views("frames") + "select frame_index, (frame_index % 7) * 500 as queue_wait_us, (frame_index % 7) * 500 + 1000 * (frame_index % 11) + decode_us as end_to_end_us from fr")
def q14_queue_wait_and_e2e(spark, sf):
    f = V.frames(spark, sf).withColumn("queued_us", F.col("ts_us") + F.col("frame_index") % 7 * 500).withColumn("now_us", F.col("queued_us") + F.col("frame_index") % 11 * 1000)
    return f.select("frame_index", (F.col("queued_us") - F.col("ts_us")).alias("queue_wait_us"), (F.col("now_us") - (F.col("ts_us") - F.col("decode_us"))).alias("end_to_end_us"))


# ---- labels and classes

_SOME = "f as (select frame_index, (frame_index % 30 - 2)::int as class_id from fr)"


def _some_classes(spark, sf):
    """Class ids from -2 to 27, so that some have no label."""
    return V.frames(spark, sf).select("frame_index", (F.col("frame_index") % 30 - 2).cast("int").alias("class_id"))


@query(with_views("frames", "labels", then=_SOME) + "select frame_index, f.class_id, coalesce(class_name, '') as class_name from f left join lab on f.class_id = lab.class_id")
def q15_label_left_join(spark, sf):
    return D.with_names(_some_classes(spark, sf), V.labels(spark, sf)).select("frame_index", "class_id", "class_name")


@query(with_views("frames", "labels", then=_SOME) + "select class_id, count(*) as frames from f where class_id not in (select class_id from lab) group by class_id")
def q16_label_missing_ids(spark, sf):
    return _some_classes(spark, sf).join(V.labels(spark, sf), "class_id", "left_anti").groupBy("class_id").agg(F.count(F.lit(1)).alias("frames"))


def _listed(names: str) -> str:
    return ", ".join(f"({i}, lower(trim('{n}')))" for i, n in enumerate(x for x in names.split(",") if x.strip()))


_NAMES = " germany,France, BRAZIL ,china,france,atlantis"


@query(with_views("labels", then=f"""n as (select * from (values {_listed(_NAMES)}) t(o, name)), f as (select o, (select min(class_id) from lab where lower(trim(class_name)) = name) as id from n),
a as (select -2 as o, 3 as id union all select -1, 1 union all select o, id from f where id is not null), u as (select id, min(o) as o from a group by id)""") + """
select string_agg(id::varchar, ',' order by o) as resolved, (select count(*) from f where id is null)::int as unknown from u""")
def q17_class_name_resolution(spark, sf):
    base = spark.range(1).select(F.array(F.lit(3), F.lit(1)).alias("ids"), X.parse_names(F.lit(_NAMES)).alias("names"))
    return D.resolve_classes(F.col("ids"), F.col("names"), V.labels(spark, sf), base).select(F.array_join("resolved", ",").alias("resolved"), "unknown")


@query(with_views("frames", "labels", then=_SOME) + "select frame_index, class_id from f where class_id in (2, 5, 7, 26) and class_id in (select class_id from lab)")
def q18_semi_selected_ids(spark, sf):
    chosen = V.labels(spark, sf).filter(F.col("class_id").isin(2, 5, 7, 26))
    return _some_classes(spark, sf).filter(F.col("class_id").isin(2, 5, 7, 26)).join(chosen, "class_id", "left_semi").select("frame_index", "class_id")


# ---- detection

_BEST = "b as (select *, list_max(scores) as top, list_position(scores, list_max(scores)) - 1 as class_id from pred where obj > 0)"
_CAND = _BEST + """, c0 as (select frame_index, prediction, class_id::int as class_id, obj * top as confidence, least(greatest(cx - w * 0.5, 0.0), 640.0) as x1, least(greatest(cy - h * 0.5, 0.0), 640.0) as y1,
  least(greatest(cx + w * 0.5, 0.0), 640.0) as x2, least(greatest(cy + h * 0.5, 0.0), 640.0) as y2 from b where top > 0 and obj * top >= 0.25),
cand as (select * from c0 where x2 > x1 and y2 > y1)"""
_IOU = "greatest(least(a.x2, d.x2) - greatest(a.x1, d.x1), 0) * greatest(least(a.y2, d.y2) - greatest(a.y1, d.y1), 0)"
_PAIR = f"""(select a.frame_index, a.prediction as a, d.prediction as d, a.class_id, a.r as ra, d.r as rd, {_IOU} as i, (a.x2 - a.x1) * (a.y2 - a.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) - {_IOU} as u
  from ranked a join ranked d on a.frame_index = d.frame_index and a.class_id = d.class_id and a.r < d.r)"""
_RANKED = "ranked as (select *, row_number() over (partition by frame_index order by confidence desc, prediction) as r from cand)"


def _nms_sql(cap: int) -> str:
    return _CAND + f""", {_RANKED}, p as {_PAIR}, sup as (select frame_index, rd, list(ra) as by_ from p where i / u > 0.45 group by 1, 2),
walk(frame_index, r, kept) as (
  select frame_index, 0::bigint, []::bigint[] from (select distinct frame_index from ranked)
  union all select w.frame_index, w.r + 1, case when len(w.kept) < {cap} and not list_has_any(w.kept, coalesce(s.by_, []::bigint[])) then list_append(w.kept, w.r + 1) else w.kept end
  from walk w join ranked k on k.frame_index = w.frame_index and k.r = w.r + 1 left join sup s on s.frame_index = w.frame_index and s.rd = w.r + 1),
fin as (select frame_index, kept from walk qualify row_number() over (partition by frame_index order by r desc) = 1),
det as (select k.frame_index, prediction, class_id, confidence, x1, y1, x2, y2 from ranked k join fin on k.frame_index = fin.frame_index where list_contains(kept, k.r))"""


_ROUND = "round(confidence, 6) as confidence, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2"


def _rounded(df):
    return df.select("frame_index", "prediction", "class_id", *[F.round(c, 6).alias(c) for c in ("confidence", "x1", "y1", "x2", "y2")])


@query(with_views("pred") + "select frame_index, prediction, round(obj, 6) as obj from pred where obj > 0")
def q19_objectness_filter(spark, sf):
    return V.predictions(spark, sf).filter("obj > 0").select("frame_index", "prediction", F.round("obj", 6).alias("obj"))


@query(with_views("pred", then=_BEST) + "select frame_index, prediction, class_id::int as class_id, round(obj * top, 6) as confidence from b where top > 0 and obj * top >= 0.25")
def q20_confidence_filter(spark, sf):
    b = V.predictions(spark, sf).filter("obj > 0").withColumn("b", D.best_class(F.col("scores"))).filter("b is not null and obj * b.score >= 0.25")
    return b.select("frame_index", "prediction", F.col("b.class_id").alias("class_id"), F.round(F.col("obj") * F.col("b.score"), 6).alias("confidence"))


@query(with_views("pred") + "select prediction, case when list_max(scores) > 0 then list_position(scores, list_max(scores)) - 1 end::int as class_id, case when list_max(scores) > 0 then round(list_max(scores), 6) end as score from pred")
def q21_argmax_all_classes(spark, sf):
    return V.predictions(spark, sf).withColumn("b", D.best_class(F.col("scores"))).select("prediction", F.col("b.class_id").alias("class_id"), F.round("b.score", 6).alias("score"))


@query(with_views("pred", then="s as (select prediction, [scores[10], scores[3], scores[18]] as k, [9, 2, 17] as ids from pred)") + "select prediction, case when list_max(k) > 0 then ids[list_position(k, list_max(k))] end::int as class_id, case when list_max(k) > 0 then round(list_max(k), 6) end as score from s")
def q22_argmax_filtered_classes(spark, sf):
    return V.predictions(spark, sf).withColumn("b", D.best_class(F.col("scores"), [9, 2, 17, 99])).select("prediction", F.col("b.class_id").alias("class_id"), F.round("b.score", 6).alias("score"))


@query(with_views("pred", then=_CAND) + f"select frame_index, prediction, class_id, {_ROUND} from cand")
def q23_box_decode_clamp(spark, sf):
    return _rounded(D.decode(V.predictions(spark, sf)))


@query(with_views("pred", then=f"{_CAND}, {_RANKED}, p as {_PAIR}") + "select frame_index, least(a, d) as a, greatest(a, d) as b, class_id, round(case when u > 0 then i / u else 0 end, 6) as iou from p")
def q24_iou_pairs(spark, sf):
    """All pairs of one class in one frame: both bounded by the detector's outputs a frame."""
    c = D.decode(V.predictions(spark, sf)).select("frame_index", "class_id", "prediction", F.struct("x1", "y1", "x2", "y2").alias("r"))
    pairs = c.alias("l").join(c.alias("g"), (F.col("l.frame_index") == F.col("g.frame_index")) & (F.col("l.class_id") == F.col("g.class_id")) & (F.col("l.prediction") < F.col("g.prediction")))
    return pairs.select(F.col("l.frame_index").alias("frame_index"), F.col("l.prediction").alias("a"), F.col("g.prediction").alias("b"), F.col("l.class_id").alias("class_id"), F.round(D.iou(F.col("l.r"), F.col("g.r")), 6).alias("iou"))


@query(with_views("pred", then=_nms_sql(300), recursive=True) + f"select frame_index, prediction, class_id, {_ROUND} from det")
def q25_nms(spark, sf):
    return _rounded(D.nms(D.decode(V.predictions(spark, sf))))


@query(with_views("pred", then=_nms_sql(5), recursive=True) + f"select frame_index, prediction, class_id, {_ROUND} from det")
def q26_nms_topk_cap(spark, sf):
    return _rounded(D.nms(D.decode(V.predictions(spark, sf)), cap=5))


@query(with_views("pred", "labels", then=_nms_sql(300), recursive=True) + "select det.class_id, coalesce(class_name, '') as class_name, count(*) as detections, count(distinct frame_index) as frames, round(max(confidence), 6) as best from det left join lab on det.class_id = lab.class_id group by 1, 2")
def q27_detection_pipeline(spark, sf):
    kept = D.with_names(D.nms(D.decode(V.predictions(spark, sf))), V.labels(spark, sf))
    return kept.groupBy("class_id", "class_name").agg(F.count(F.lit(1)).alias("detections"), F.count_distinct("frame_index").alias("frames"), F.round(F.max("confidence"), 6).alias("best"))


@query(with_views("pred", "labels", then=_CAND) + """select frame_index, printf('%.6f', frame_index * 1000.0::double / 25) as timestamp_ms, cand.class_id, coalesce(class_name, '') as class_name, printf('%.6f', confidence) as confidence,
  printf('%.3f', x1) as x1, printf('%.3f', y1) as y1, printf('%.3f', x2) as x2, printf('%.3f', y2) as y2 from cand left join lab on cand.class_id = lab.class_id""")
def q28_detections_csv_rows(spark, sf):
    d = D.decode(V.predictions(spark, sf)).withColumn("timestamp_ms", W.timestamp_ms(F.col("frame_index"), F.lit(25.0)))
    return D.csv_rows(D.with_names(d, V.labels(spark, sf)))


# ---- pixels


def _pixels(df):
    return df.select("frame_index", F.posexplode("px").alias("i", "p"))


_GRAY = "(0.299::double * r + 0.587::double * g + 0.114::double * b + 0.5)"
_RGB = "rgb as (select frame_index, i // 3 as q, max(case when i % 3 = 0 then p end) as r, max(case when i % 3 = 1 then p end) as g, max(case when i % 3 = 2 then p end) as b from px where i < 48 group by 1, 2)"


@query(f"with g as (select (17 * (i % 17) + 3 * (i // 17)) & 255 as r, (5 * (i % 17) + 29 * (i // 17)) & 255 as g, (11 * (i % 17) + 7 * (i // 17)) & 255 as b, i from range(255) t(i)) select 0 as frame_index, (i * 3 + c)::int as i, trunc{_GRAY}::int as p from g, range(3) s(c)")
def q29_grayscale_pattern(spark, sf):
    return _pixels(P.apply_filter(V.pattern(spark), "grayscale", 17, 15))


@query(with_views("px", then=_RGB) + f"select frame_index, (q * 3 + c)::int as i, trunc{_GRAY}::int as p from rgb, range(3) s(c)")
def q30_grayscale_frames(spark, sf):
    return _pixels(P.filter_arrays(V.rgb24(spark, sf), "grayscale", 4, 4))


def _blur_sql(k: int) -> str:
    r = k // 2
    return with_views("px", then=f"o as (select a as dx, b as dy from range({-r}, {r + 1}) s(a), range({-r}, {r + 1}) t(b)), c as (select frame_index, i, i % 3 as c, (i // 3) % 4 as x, i // 12 as y from px where i < 48), n as (select c.frame_index, c.i, least(greatest(y + dy, 0), 3) * 12 + least(greatest(x + dx, 0), 3) * 3 + c as j from c, o)") + f"select n.frame_index, n.i::int as i, (sum(px.p) // {k * k})::int as p from n join px on px.frame_index = n.frame_index and px.i = n.j group by 1, 2"


def _blur(k):
    return lambda spark, sf: _pixels(P.filter_arrays(V.rgb24(spark, sf), f"blur{k}x{k}", 4, 4))


for _n, _k in ((31, 3), (32, 5), (33, 9), (34, 13)):
    QUERIES[f"q{_n}_blur{_k}"], ORACLES[f"q{_n}_blur{_k}"] = _blur(_k), _blur_sql(_k)

_YUV = "least(greatest(yy + 1.402::double * v, 0), 255) / 255 as r, least(greatest(yy - 0.344136::double * u - 0.714136::double * v, 0), 255) / 255 as g, least(greatest(yy + 1.772::double * u, 0), 255) / 255 as b"


def _planes(df, width):
    i = F.col("i")
    out = df.select("frame_index", F.posexplode(F.arrays_zip("r", "g", "b")).alias("i", "p"))
    return out.select("frame_index", (i % width).alias("x"), F.floor(i / width).cast("int").alias("y"), *[F.round(f"p.{c}", 6).alias(c) for c in "rgb"])


@query(with_views("px", then="a as (select frame_index, list(p order by i) as a from px where i < 48 group by 1), s as (select frame_index, (t % 8)::int as x, (t // 8)::int as y, a[1 + t]::double as yy, a[33 + (t // 16) * 8 + (t % 8) - (t % 2)]::double - 128 as u, a[34 + (t // 16) * 8 + (t % 8) - (t % 2)]::double - 128 as v from a, range(32) z(t))")
       + f"select frame_index, x, y, round(r, 6) as r, round(g, 6) as g, round(b, 6) as b from (select frame_index, x, y, {_YUV} from s)")
def q35_nv12_to_rgb_nearest(spark, sf):
    return _planes(P.preprocess_arrays(V.nv12(spark, sf), 8, 4, 8, 4, bilinear=False), 8)


_SIZES = ((3840, 2160), (1080, 1920), (640, 640), (1280, 720), (17, 15), (1920, 1080))
_INPUTS = ((640, 640), (416, 416), (1280, 640))


@query("with s as (select * from (values " + ", ".join(f"({w}, {h})" for w, h in _SIZES) + ") t(w, h)), i as (select * from (values " + ", ".join(f"({w}, {h})" for w, h in _INPUTS) + ") t(tw, th)), k as (select *, least(tw::double / w, th::double / h) as s from s, i) select w, h, tw, th, round(s, 9) as scale, round((tw - w * s) / 2, 6) as pad_x, round((th - h * s) / 2, 6) as pad_y from k")
def q36_letterbox_geometry(spark, sf):
    a, b = spark.createDataFrame(_SIZES, "w int, h int"), spark.createDataFrame(_INPUTS, "tw int, th int")
    k = a.crossJoin(F.broadcast(b)).withColumn("k", P.letterbox(F.col("w"), F.col("h"), F.col("tw"), F.col("th")))  # two option lists
    return k.select("w", "h", "tw", "th", F.round("k.scale", 9).alias("scale"), F.round("k.pad_x", 6).alias("pad_x"), F.round("k.pad_y", 6).alias("pad_y"))


@query(with_views("px", then="""a as (select frame_index, list(p order by i) as a from px where i < 48 group by 1),
s as (select frame_index, a, (t % 16)::int as x, (t // 16)::int as y, (t % 16) / 2.0::double as sx, ((t // 16) - 4) / 2.0::double as sy from a, range(256) z(t)),
k as (select *, floor(sx)::int as x0, floor(sy)::int as y0, least(floor(sx)::int + 1, 7) as x1, least(floor(sy)::int + 1, 3) as y1 from s where sx >= 0 and sy >= 0 and sx <= 7 and sy <= 3),
m as (select *, a[1 + y0 * 8 + x0]::double as p00, a[1 + y0 * 8 + x1]::double as p10, a[1 + y1 * 8 + x0]::double as p01, a[1 + y1 * 8 + x1]::double as p11, least(x0 - x0 % 2, 6) as cx, least(floor(sy * 0.5)::int, 1) as cy from k),
n as (select *, p00 + (p10 - p00) * (sx - x0) as top, p01 + (p11 - p01) * (sx - x0) as low, a[33 + cy * 8 + cx]::double - 128 as u, a[34 + cy * 8 + cx]::double - 128 as v from m),
q as (select frame_index, x, y, top + (low - top) * (sy - y0) as yy, u, v from n)""")
       + f"select frame_index, x, y, round(r, 6) as r, round(g, 6) as g, round(b, 6) as b from (select frame_index, x, y, {_YUV} from q) union all select frame_index, x, y, round(114.0::double / 255, 6), round(114.0::double / 255, 6), round(114.0::double / 255, 6) from s where not (sx >= 0 and sy >= 0 and sx <= 7 and sy <= 3)")
def q37_preprocess_bilinear(spark, sf):
    return _planes(P.preprocess_arrays(V.nv12(spark, sf), 8, 4, 16, 16, bilinear=True), 16)


@query(with_views("px", then="""e as (select vec_id as frame_index, abs(embedding[1]::double) * 8 as x1, abs(embedding[2]::double) * 8 as y1, (abs(embedding[1]::double) + 0.4::double) * 8 as x2, (abs(embedding[2]::double) + 0.5::double) * 8 as y2, embedding[3]::double + 0.5 as confidence from embeddings),
f as (select frame_index, greatest(least(trunc(x1)::int, 7), 0) as x1, greatest(least(trunc(y1)::int, 7), 0) as y1, greatest(least(trunc(x2)::int, 7), 0) as x2, greatest(least(trunc(y2)::int, 7), 0) as y2 from e where confidence >= 0.4::double)""") + """
select px.frame_index, px.i::int as i, case when f.x2 > f.x1 and f.y2 > f.y1 and ((i % 8 between x1 and x2 and i // 8 in (y1, y2)) or (i // 8 between y1 and y2 and i % 8 in (x1, x2))) then 235 else p end as p from px left join f on px.frame_index = f.frame_index""")
def q38_overlay_luma(spark, sf):
    at = lambda i: F.col("embedding")[i].cast("double")
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_index"), F.expr(f"transform(embedding, v -> {V.BYTE.format(v='v')})").alias("px"), (at(2) + 0.5).alias("confidence"), F.struct((F.abs(at(0)) * 8).alias("x1"), (F.abs(at(1)) * 8).alias("y1"), ((F.abs(at(0)) + 0.4) * 8).alias("x2"), ((F.abs(at(1)) + 0.5) * 8).alias("y2")).alias("b"))
    boxes = F.filter(F.array(F.struct("b.*", "confidence")), lambda b: b["confidence"] >= 0.4)
    return _pixels(e.select("frame_index", P.overlay(F.col("px"), boxes, 8, 8, 1).alias("px")))


_DIMS = ((8, 2), (7, 2), (8, 3), (0, 2), (8, 0), (3840, 2160), (1920, 1080), (-4, 4))
_DIM_SQL = "d as (select w, h, f from (values " + ", ".join(f"({w}, {h})" for w, h in _DIMS) + ") t(w, h), (values ('rgb24'), ('gray8'), ('nv12'), ('yuv')) u(f))"


def _dims(spark):
    return spark.createDataFrame([(w, h, f) for w, h in _DIMS for f in ("rgb24", "gray8", "nv12", "yuv")], "w int, h int, f string")


@query(f"with {_DIM_SQL} select w, h, f, (case when w <= 0 then 0 when f = 'rgb24' then 3 * w when f in ('gray8', 'nv12') then w else 0 end)::bigint as stride, (case when w <= 0 or h <= 0 then 0 when f = 'rgb24' then 3 * w * h when f = 'gray8' then w * h when f = 'nv12' and w % 2 = 0 and h % 2 = 0 then w * h * 3 // 2 else 0 end)::bigint as size from d")
def q39_frame_sizes(spark, sf):
    w, h, f = F.col("w"), F.col("h"), F.col("f")
    return _dims(spark).select(w, h, f, C.frame_stride(w, f).alias("stride"), C.frame_size(w, h, f).alias("size"))


@query(f"with {_DIM_SQL} select w, h, f, (case f when 'rgb24' then 3 * w * h when 'gray8' then w * h when 'nv12' then w * h * 3 // 2 else 0 end)::bigint as frame_bytes, round(case when 25 > 0 then 100 / 25.0 end, 3)::double as duration_sec from d where w > 0 and h > 0")
def q40_video_profile(spark, sf):
    w, h, f = F.col("w"), F.col("h"), F.col("f")
    return _dims(spark).filter("w > 0 and h > 0").select(w, h, f, C.profile_bytes(w, h, f).alias("frame_bytes"), F.round(F.lit(100) / F.lit(25.0), 3).alias("duration_sec"))


# ---- planning

#: frame bytes, upload, download, frames a second, free VRAM, GB/s, ratio, reserve, auto-tune, batch, in flight, overlap, parallel, contexts
_GRID_COLUMNS = "n int, frame_bytes bigint, raw_upload boolean, raw_download boolean, video_fps double, free_vram bigint, h2d_gbps double, d2h_gbps double, vram_budget_ratio double, vram_reserve_mb int, auto_tune boolean, batch_size int, inflight_batches int, overlap_mode string, parallel_mode string, concurrent_kernels boolean, max_contexts int, true_batch boolean, max_batch int, manual_contexts int"
_GIB = 1 << 30


def _grid_rows():
    rows, n = [], 0
    for size, fps in ((12441600, 60.0), (1382400, 60.0), (1382400, 240.0), (3110400, 0.0)):
        for free in (3 * _GIB, _GIB, 0):
            for up, down, rate in ((False, False, 10.0), (True, False, 10.0), (True, False, 1.0), (False, True, 0.0)):
                for tune, batch, flight, over, par, kernels, contexts in ((True, 0, 0, "auto", "auto", False, 3), (True, 0, 0, "auto", "on", True, 3), (False, 1, 1, "auto", "auto", True, 3), (False, 0, 0, "on", "off", True, 3), (True, 4, 2, "off", "auto", True, 2), (False, 5, 1, "auto", "on", True, 1)):
                    n += 1
                    rows.append((n, size, up, down, fps, free, rate, rate, 0.375, 700 if n % 5 == 0 else 0, tune, batch, flight, over, par, kernels, contexts, n % 4 == 0, 4, 2 if n % 7 == 0 else 0))
    return rows


def _grid(spark):
    g = spark.createDataFrame(_grid_rows(), _GRID_COLUMNS)
    fixed = {"in_bytes": F.lit(4915200).cast("long"), "out_bytes": F.lit(8568000).cast("long"), "total_vram": F.lit(4 * _GIB).cast("long"), "cuda_available": F.lit(True), "target_fps": F.lit(0.0), "async_engines": F.lit(2), "parallel_contexts": F.lit(True)}
    return g.withColumns(fixed)


def _grid_sql() -> str:
    rows = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::double" if isinstance(v, float) else f"{v}::bigint" if v > 2**31 - 1 else str(v) for v in r) + ")" for r in _grid_rows())
    names = ", ".join(c.split()[0] for c in _GRID_COLUMNS.split(", "))
    return f"""g as (select * from (values {rows}) t({names})),
b0 as (select *, frame_bytes::bigint + 4915200 + 8568000 + greatest(frame_bytes // 4, 4194304) as per_frame, case when vram_reserve_mb > 0 then vram_reserve_mb::bigint * 1048576 else greatest(536870912, floor(4294967296 * 0.2::double)::bigint) end as reserve,
  case when video_fps > 0 then video_fps else 30.0::double end as fps from g),
b as (select *, case when least(floor(4294967296 * vram_budget_ratio)::bigint, greatest(free_vram::bigint - reserve, 0)) = 0 then per_frame * 2 else least(floor(4294967296 * vram_budget_ratio)::bigint, greatest(free_vram::bigint - reserve, 0)) end as budget from b0),
k as (select b.*, c, per_frame * c + 16777216 <= budget as mem, h2d_gbps <= 0 or d2h_gbps <= 0 or (case when raw_upload then frame_bytes * c / (h2d_gbps * 0.7::double * 1e9::double) * 1000 + 0.05::double else 0 end + case when raw_download then frame_bytes * c / (d2h_gbps * 0.7::double * 1e9::double) * 1000 + 0.05::double else 0 end) <= 1000.0::double / fps * c * 0.25::double as fit from b, (values (1), (2), (3), (4), (6), (8)) t(c))"""


@query(f"with {_grid_sql()} select n, c as candidate, per_frame as per_frame_bytes, budget as vram_budget_bytes, mem as fits_memory, fit as fits_transfer from k")
def q41_plan_candidates(spark, sf):
    return C.candidates(_grid(spark)).select("n", "candidate", "per_frame_bytes", "vram_budget_bytes", "fits_memory", "fits_transfer")


@query(f"""with {_grid_sql()}, best as (select n, coalesce(max(c) filter (mem and fit), 1) as tuned from k group by n),
p as (select b.*, case when batch_size > 0 then batch_size when auto_tune then tuned else 1 end as sched from b join best on b.n = best.n),
p2 as (select *, case when true_batch and max_batch > 1 then least(sched, max_batch) else 1 end as backend, case when inflight_batches > 0 then inflight_batches when auto_tune and budget >= per_frame * sched * 4 then 2 else 1 end as fl from p),
p3 as (select *, sched * fl as act, per_frame * sched + 16777216 as est, (raw_upload or raw_download) and sched > 1 as tb from p2),
p4 as (select *, overlap_mode = 'on' or (overlap_mode = 'auto' and auto_tune and act > 1) as ov, case when parallel_mode = 'off' then 1 else greatest(least(case when manual_contexts > 0 then manual_contexts when sched > 1 then sched else fl end, case when not concurrent_kernels and parallel_mode = 'auto' then 1 else max_contexts end, act), 1) end as ctx from p3)
select n, sched::int as schedule_batch, backend::int as backend_batch, fl::int as inflight, act::int as active_frames, est::bigint as estimated_bytes, greatest(budget - est, 0)::bigint as unused_bytes, tb as transfer_batching, ov as overlap, ctx::int as contexts,
  case when parallel_mode = 'on' and ctx <= 1 then 'parallel inference requested but unsupported by current runtime/resources' when not auto_tune and batch_size <= 0 then 'auto-tune disabled; preserving single-frame behavior' when not true_batch and sched > 1 then 'schedule batch exceeds backend batch; running single-frame inference lanes' else 'selected by execution planner' end as reason,
  case when ctx > 1 then 3 when ov then 2 when tb then 1 else 0 end as execution_mode from p4""")
def q42_execution_plan(spark, sf):
    return C.plan(_grid(spark)).select("n", "schedule_batch", "backend_batch", "inflight", "active_frames", "estimated_bytes", "unused_bytes", "transfer_batching", "overlap", "contexts", "reason", "execution_mode")


@query("""with d as (select * from (values ('cpu'), ('nvdec')) a(decoder), (values ('cuda'), ('cpu')) b(device), (values (true), (false)) c(draw), (values ('libx264'), ('h264_nvenc'), ('mpeg4')) e(encoder), (values ('tensorrt'), ('onnxruntime'), ('torchscript')) f(runtime))
select *, case when decoder = 'cpu' and device = 'cuda' then true else false end as upload, decoder = 'nvdec' and device = 'cpu' as download, case when not draw then 'csv_only' when encoder = 'h264_nvenc' then 'cuda_annotated' else 'cpu_annotated' end as output_mode,
  not (draw and encoder <> 'h264_nvenc') and not (draw and encoder = 'h264_nvenc' and (decoder = 'cpu' or device = 'cpu')) and not (runtime = 'tensorrt' and device = 'cpu') as legal from d""")
def q43_topology_matrix(spark, sf):
    domains = [("decoder", ("cpu", "nvdec")), ("backend_device", ("cuda", "cpu")), ("draw_boxes", (True, False)), ("encoder", ("libx264", "h264_nvenc", "mpeg4")), ("runtime", ("tensorrt", "onnxruntime", "torchscript"))]
    df = spark.range(1)
    for name, values in domains:
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return C.topology(df).select("decoder", F.col("backend_device").alias("device"), F.col("draw_boxes").alias("draw"), "encoder", "runtime", F.col("requires_raw_upload").alias("upload"), F.col("requires_raw_download").alias("download"), "output_mode", (F.col("error") == "").alias("legal"))


@query("""with d as (select * from (values ('auto'), ('low'), ('balanced'), ('manual')) a(profile), (values (true), (false)) b(lossless), (values ('cpu'), ('gpu')) c(mode), (values (0), (60), (200)) e(budget_mb), (values (1), (4)) f(processor_workers)),
l as (select *, profile = 'low' or (profile = 'auto' and lossless) as low from d),
s as (select *, case when low then 1 else 3 end as s0, case when mode = 'gpu' then 1 when low then 1 when profile = 'balanced' then least(processor_workers, 2) else processor_workers end as w0 from l),
k as (select *, budget_mb > 0 and 2 * (s0 + w0 + 1)::bigint * 6220800 > budget_mb::bigint * 1048576 and profile <> 'manual' as shrunk from s),
z as (select *, case when shrunk then 1 else s0 end as slots, case when shrunk then 1 else w0 end as workers from k)
select profile, lossless, mode, budget_mb, processor_workers, slots, workers, case when low then 2 else 4 end as decoder_threads, slots + workers + 1 as pool_frames, 2 * (slots + workers + 1)::bigint * 6220800 as pool_bytes, shrunk, budget_mb > 0 and 2 * (slots + workers + 1)::bigint * 6220800 > budget_mb::bigint * 1048576 as over_budget from z""")
def q44_memory_profile_matrix(spark, sf):
    df = spark.range(1)
    for name, values in (("profile", ("auto", "low", "balanced", "manual")), ("lossless", (True, False)), ("mode", ("cpu", "gpu")), ("budget_mb", (0, 60, 200)), ("processor_workers", (1, 4))):
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    out = C.memory_profile(df.withColumns({"frame_slots": F.lit(3), "decoder_threads": F.lit(4), "encoder_threads": F.lit(4), "frame_bytes": F.lit(6220800).cast("long")}))
    return out.select("profile", "lossless", "mode", "budget_mb", "processor_workers", "slots", "workers", "decoder_threads", "pool_frames", "pool_bytes", "shrunk", "over_budget")


_MODELS = ("m.engine", "a/b.PLAN", "M.ONNX", "x.pt", "x.ts", "dir.onnx/x.torchscript", "x.weights", "noext", "", "a.b.onnx")
_MODEL_SQL = "m as (select * from (values " + ", ".join(f"('{m}')" for m in _MODELS) + ") t(path)), k as (select path, case when regexp_matches(lower(path), '\\.(engine|plan)$') then 'tensorrt' when regexp_matches(lower(path), '\\.onnx$') then 'onnxruntime' when regexp_matches(lower(path), '\\.(pt|ts|torchscript)$') then 'torchscript' else 'auto' end as runtime from m)"


@query(f"with {_MODEL_SQL} select path, runtime, case runtime when 'tensorrt' then 'engine' when 'onnxruntime' then 'onnx' when 'torchscript' then 'torchscript' else 'unknown' end as model_format from k")
def q45_runtime_from_extension(spark, sf):
    r = C.runtime_of(F.col("path"))
    return spark.createDataFrame([(m,) for m in _MODELS], "path string").select("path", r.alias("runtime"), F.when(r == "tensorrt", "engine").when(r == "onnxruntime", "onnx").when(r == "torchscript", "torchscript").otherwise("unknown").alias("model_format"))


@query(f"with {_MODEL_SQL}, r as (select * from (values ('auto'), ('tensorrt'), ('onnxruntime')) t(asked)) select path, asked, case when path = '' then 'model path is empty' when runtime = 'auto' then 'unsupported model extension. Supported: .engine, .plan, .onnx, .pt, .ts, .torchscript' when asked <> 'auto' and asked <> runtime then 'model extension selects ' || runtime || ' but --runtime is ' || asked else '' end as message from k, r")
def q46_validate_model(spark, sf):
    df = spark.createDataFrame([(m, r) for m in _MODELS for r in ("auto", "tensorrt", "onnxruntime")], "path string, asked string")
    return df.select("path", "asked", C.validate_model(F.col("path"), F.col("asked")).alias("message"))


# ---- text

_LISTS = ("0, 2,2", "7", "0,,2", " 1 ,\t3", "a,1", "-1,2", "", "5,4,5,4", "1 2", "person,, traffic light", " car ,car,, bus ")
_LIST_SQL = "l as (select * from (values " + ", ".join("('" + v + "')" for v in _LISTS) + ") t(text)), s as (select text, list_transform(string_split(text, ','), lambda x: trim(x, ' ' || chr(9))) as k from l)"


@query(f"with {_LIST_SQL}, i as (select text, case when len(list_filter(k, lambda x: not regexp_full_match(x, '[+]?[0-9]{{1,9}}'))) = 0 then list_transform(k, lambda x: x::int) end as n from s) select text, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), ',') as ids, array_to_string(list_sort(list_distinct(n)), ',') as sorted_ids from i")
def q47_id_list_parse(spark, sf):
    ids = X.parse_ids(F.col("text"))
    return spark.createDataFrame([(t,) for t in _LISTS], "text string").select("text", F.array_join(ids, ",").alias("ids"), X.join_ids(ids).alias("sorted_ids"))


@query(f"with {_LIST_SQL}, i as (select text, list_filter(k, lambda x: x <> '') as n from s) select text, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), '|') as names from i")
def q48_name_list_parse(spark, sf):
    return spark.createDataFrame([(t,) for t in _LISTS], "text string").select("text", F.array_join(X.parse_names(F.col("text")), "|").alias("names"))


@query(with_views("logs") + "select line_no, split_part(split_part(text, 'completed ', 2), ' ', 1)::int as completed, split_part(text, 'wall_clock_fps=', 2)::double as fps from lg where text like 'progress:%'")
def q49_log_progress_parse(spark, sf):
    return X.parsed(V.logs(spark, sf)).filter("completed is not null").select("line_no", "completed", "fps")


@query(with_views("logs", then="k as (select is_error or lower(text) like '%error%' or lower(text) like '%failed%' as error, lower(text) like '%warn%' as warning, text like '%TensorRT%' as tensorrt, "
                  + " or ".join(f"contains(lower(text), '{w}')" for w in X.PLAN_WORDS) + " as plan from lg)") + "select error, warning, tensorrt, plan, count(*) as lines from k group by 1, 2, 3, 4")
def q50_log_classify(spark, sf):
    return X.classify(V.logs(spark, sf)).groupBy("error", "warning", "tensorrt", "plan").agg(F.count(F.lit(1)).alias("lines"))


@query(with_views("logs") + "select line_no, text from lg order by line_no desc limit 500")
def q51_log_tail(spark, sf):
    return X.tail(V.logs(spark, sf), 500).select("line_no", "text")


@query(with_views("frames", then="e as (select frame_index, decode_ms, (frame_index % 101) / 100.0::double as done from fr), k as (select *, case when done > 0 and done < 1 then decode_ms * ((1 - done) / done) else 0 end as eta, case when done > 0 and done < 1 then decode_ms / done when done >= 1 then decode_ms else 0 end as total from e)")
       + "select frame_index, round(eta, 6) as eta_seconds, round(total, 6) as total_seconds, case when eta <= 0 then '--' when floor(eta) >= 3600 then printf('%d:%02d:%02d', (floor(eta)::bigint // 3600), (floor(eta)::bigint % 3600) // 60, floor(eta)::bigint % 60) else printf('%d:%02d', floor(eta)::bigint // 60, floor(eta)::bigint % 60) end as eta_text from k")
def q52_eta(spark, sf):
    e = V.frames(spark, sf).withColumn("e", X.eta(F.col("decode_ms"), F.col("frame_index") % 101 / 100.0))
    return e.select("frame_index", F.round("e.eta_seconds", 6).alias("eta_seconds"), F.round("e.total_seconds", 6).alias("total_seconds"), X.duration(F.col("e.eta_seconds")).alias("eta_text"))


_FAMILIES = ("my run.v1!", "clip-01", "***", "", "a b.c_d", "été 4K")
_PATHS = ("a.b/out", "out.mp4", "x/y.z.mov", "noext", "d.ir\\name")


@query("with f as (select * from (values " + ", ".join(f"('{f}')" for f in _FAMILIES) + ") t(name)), k as (select name, regexp_replace(translate(name, ' .', '__'), '[^A-Za-z0-9_-]', '', 'g') as f0 from f), n as (select name, case when f0 = '' then 'output' else f0 end as f from k) select name, f || '_video.mkv' as video, f || '_detections.csv' as detections, f || '_benchmark.csv' as benchmark from n")
def q53_artifact_names(spark, sf):
    return spark.createDataFrame([(f,) for f in _FAMILIES], "name string").select("name", *X.artifact_names(F.col("name"), F.lit("mkv")))


_SHAPES = ((1, 25200, 85), (1, 85, 25200), (1, 84, 8400), (1, 25200, 90), (25200, 84), (85,), (1, 84, 85), (2, 100, 85))


@query("with d as (select * from (values " + ", ".join(f"({list(s)})" for s in _SHAPES) + ") t(dims)), k as (select array_to_string(dims, 'x') as shape, dims[-1] as l, case when len(dims) > 1 then dims[-2] end as p, list_product(dims)::bigint as v from d) "
       "select shape, (case when l = 85 then v // 85 when p = 85 then l when l = 84 then v // 84 when p = 84 then l end)::int as predictions, case when l = 85 then false when p = 85 then true when l = 84 then false when p = 84 then true end as transposed, case when l = 85 or p = 85 then 5 when l = 84 or p = 84 then 4 end::int as class_offset, 25200::int as default_640 from k")
def q54_output_shape_resolution(spark, sf):
    df = spark.createDataFrame([(list(s),) for s in _SHAPES], "dims array<int>").withColumn("s", D.output_shape(F.col("dims"), F.lit(80)))
    return df.select(F.array_join(F.col("dims").cast("array<string>"), "x").alias("shape"), "s.predictions", "s.transposed", "s.class_offset", D.default_predictions(F.lit(640), F.lit(640)).alias("default_640"))


# ---- streaming and files


def _streamed(spark, sf, columns):
    """The frames as a file stream; the file's folder is read with a filter on its name."""
    whole = V.table(spark, sf, "events")
    folder, name = whole.inputFiles()[0].rsplit("/", 1)
    pattern = "*.parquet" if folder.endswith("events.parquet") else name
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", pattern).parquet(folder)
    return stream.select(*columns)


_SHARES = {c: k for k, c in enumerate(T.SUMMED, 1)}  # durations of whole microseconds, so that sums are exact in any order


@query(with_views("frames") + "select event_type, count(*) as frames, " + ", ".join(f"sum(decode_us * {k})::bigint as {c}" for c, k in _SHARES.items()) + " from fr group by event_type")
def q55_stream_running_benchmark(spark, sf):
    from .streaming import flows

    us = F.floor(F.col("value") * 1000).cast("long")
    s = _streamed(spark, sf, ["event_type", *[(us * k).alias(c) for c, k in _SHARES.items()]])
    return flows.drained(spark, flows.running_benchmark(s, "event_type", fields=T.SUMMED), f"bench-{uuid.uuid4().hex}", "complete")


@query("select (event_id % 4)::int as stream_id, event_id // 4 as frame_index, user_id as payload from events")
def q56_stream_reorder(spark, sf):
    from .streaming import flows

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = _streamed(spark, sf, [(F.col("event_id") % 4).cast("int").alias("stream_id"), F.floor(F.col("event_id") / 4).alias("frame_index"), F.col("user_id").alias("payload")])
    return flows.drained(spark, flows.in_order(s), f"order-{uuid.uuid4().hex}", "append")


@query(_blur_sql(3))
def q57_numpy_filters_in_arrow(spark, sf):
    # bytes of a frame from its hexadecimal digits, so that no Python runs before the filter
    hex_ = F.array_join(F.transform("px", lambda p: F.lpad(F.hex(p), 2, "0")), "")
    f = V.rgb24(spark, sf).select("frame_index", F.lit(4).alias("width"), F.lit(4).alias("height"), F.unhex(hex_).alias("data"))
    out = P.filter_frames(f, "blur3x3")
    byte = lambda i: F.conv(F.hex(F.substring("data", i + 1, 1)), 16, 10).cast("int")
    return _pixels(out.select("frame_index", F.array(*[byte(i) for i in range(48)]).alias("px")))


@query("select * from (values ('tensorrt', false, false, false, false, false, false, 'not compiled'), ('onnxruntime', true, true, true, true, true, false, 'linked'), ('torchscript', false, false, false, false, false, false, 'not compiled')) t(runtime, compiled, cuda_available, cpu_available, gpu_io_available, true_batch, multi_context, version)")
def q58_backend_registry(spark, sf):
    return C.registry(spark, compiled=("onnxruntime",))


@query(with_views("frames") + "select count(*) as frames, round(sum(round(decode_ms, 6) + round(decode_ms * 2, 6)), 3) as total_ms from fr")
def q59_csv_roundtrip(spark, sf):
    from .sources import sinks
    from .sources.frames import read_report

    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    t = V.frames(spark, sf).withColumn("process_ms", F.col("decode_ms") * 2).withColumn("total_ms", F.col("decode_ms") + F.col("process_ms"))
    sinks.write_report(t.select("frame_index", "decode_ms", "process_ms", "total_ms"), path)
    return read_report(spark, path).agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("value"), 3).alias("total_ms"))


@query(ORACLES["q37_preprocess_bilinear"].split("select frame_index, x, y, round(r, 6)")[0].rstrip()
       + f""", w as (select frame_index, x, y, r, g, b from (select frame_index, x, y, {_YUV} from q) union all select frame_index, x, y, 114.0::double / 255, 114.0::double / 255, 114.0::double / 255 from s where not (sx >= 0 and sy >= 0 and sx <= 7 and sy <= 3)),
cell as (select frame_index, (y // 8) * 2 + x // 8 as prediction, (x // 8) * 8 + 4 as cx, (y // 8) * 8 + 4 as cy, avg(r::float::double)::float::double as r, avg(g::float::double)::float::double as g, avg(b::float::double)::float::double as b,
  ((avg(r::float::double) + avg(g::float::double) + avg(b::float::double)) / 3)::float::double as obj from w group by frame_index, x // 8, y // 8),
box as (select frame_index, prediction::int as prediction, greatest(r, g, b) as top, (case when r >= g and r >= b then 0 when g >= b then 1 else 2 end)::int as class_id, obj * greatest(r, g, b) as confidence,
  least(greatest((cx - 4.0) / 2, 0.0), 8.0)::double as x1, least(greatest((cy - 8.0) / 2, 0.0), 4.0)::double as y1, least(greatest((cx + 4.0) / 2, 0.0), 8.0)::double as x2, least(greatest(cy / 2.0, 0.0), 4.0)::double as y2 from cell where obj > 0)
select frame_index, prediction, class_id, round(confidence, 4) as confidence, x1, y1, x2, y2 from box where top > 0 and confidence >= 0.2 and x2 > x1 and y2 > y1""")
def q60_backend_inference(spark, sf):
    """Frames through a backend and back to candidates: the deterministic stand-in, as no model file comes along."""
    from .operators import backends

    out = backends.infer(P.preprocess_arrays(V.nv12(spark, sf), 8, 4, 16, 16, bilinear=True), "stand-in", None, 16, 16)
    kept = D.decode(D.read_outputs(out, 3), confidence=0.2, width=8, height=4, scale=2.0, pad_x=0.0, pad_y=4.0)
    return kept.select("frame_index", "prediction", "class_id", F.round("confidence", 4).alias("confidence"), "x1", "y1", "x2", "y2")


@query("with p as (select * from (values " + ", ".join(f"('{p}')" for p in _PATHS) + ") t(path)) select path, regexp_replace(path, '^(.*?)(\\.[^./\\\\]*)?$', '\\1.mkv') as video from p")
def q61_output_extension(spark, sf):
    return spark.createDataFrame([(p,) for p in _PATHS], "path string").select("path", X.with_extension(F.col("path"), "mkv").alias("video"))


@query(with_views("frames", then="k as (select decode_us, event_type from fr)") + """select event_type, case when s < 1024 then printf('%.0f B', s::double) when s < 1048576 then printf('%.2f KB', s / 1024.0::double) when s < 1073741824 then printf('%.2f MB', s / 1048576.0::double) when s < 1099511627776 then printf('%.2f GB', s / 1073741824.0::double) else printf('%.2f TB', s / 1099511627776.0::double) end as size
from (select event_type, sum(decode_us)::bigint as s from k group by 1)""")
def q62_byte_sizes(spark, sf):
    return V.frames(spark, sf).groupBy("event_type").agg(F.sum("decode_us").alias("s")).select("event_type", X.byte_size(F.col("s")).alias("size"))


@query(with_views("logs", then="p as (select line_no, text, regexp_extract(text, 'completed ([0-9]+)', 1) as c, regexp_extract(text, 'wall_clock_fps=([0-9.]+)', 1) as f, regexp_extract(text, '^batch_size: (.*)$', 1) as b from lg)") + "select arg_max(text, line_no) as last_line, (arg_max(c, line_no) filter (c <> ''))::int as completed, (arg_max(f, line_no) filter (f <> ''))::double as fps, arg_max(b, line_no) filter (b <> '') as batch_size from p")
def q63_latest_progress(spark, sf):
    return X.latest(V.logs(spark, sf)).select("last_line", "completed", "fps", "batch_size")


from . import reports  # noqa: E402,F401  (adds its queries)
