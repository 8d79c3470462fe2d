"""Text functions of the command line, reports and logs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = r"[ \t\r\n]"
#: limits of class lists (fixed values)
MOST_CLASSES, MOST_NAME = 128, 64


def trim(c: Column, left: bool = True) -> Column:
    """Without blanks at the end and, unless a label file is read for output, at the start."""
    out = F.regexp_replace(c, BLANK + "+$", "")
    return F.regexp_replace(out, "^" + BLANK + "+", "") if left else out


def label_lines(lines: DataFrame, left: bool = True) -> DataFrame:
    """(class_id, class_name) of (line_no, text): position among the lines that are not blank. One small file."""
    kept = lines.select("line_no", trim(F.col("text"), left).alias("class_name")).filter("class_name <> ''")
    return kept.select((F.row_number().over(Window.orderBy("line_no")) - 1).cast("int").alias("class_id"), "class_name")


def parse_ids(c: Column) -> Column:
    """Distinct ids of a comma list in first-seen order; null if any token is empty, negative or not a whole number, or there are more than 128."""
    tokens = F.transform(F.split(c, ","), lambda x: trim(x))
    ids = F.transform(tokens, lambda x: F.when(x.rlike(r"^[+]?\d{1,9}$"), F.expr("1")).otherwise(F.lit(0)))
    fine = F.forall(ids, lambda x: x == 1)
    out = F.array_distinct(F.transform(tokens, lambda x: F.try_to_number(F.regexp_replace(x, r"^\+", ""), F.lit("999999999")).cast("int")))
    return F.when(fine & (F.size(out) <= MOST_CLASSES), out)


def parse_names(c: Column) -> Column:
    """Distinct trimmed names of a comma list, empty ones skipped; null if one has 64 bytes or more, or there are more than 128."""
    out = F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: trim(x)), lambda x: x != ""))
    return F.when((F.size(out) <= MOST_CLASSES) & F.forall(out, lambda x: F.octet_length(x) < MOST_NAME), out)


def join_ids(ids: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(ids, lambda x: x >= 0))), ",")


def with_extension(path: Column, ext: str) -> Column:
    """The path's extension replaced, or added; a dot before the last slash is none."""
    return F.regexp_replace(path, r"^(.*?)(\.[^./\\]*)?$", f"$1.{ext}")


def family_name(c: Column) -> Column:
    out = F.regexp_replace(F.translate(c, " .", "__"), "[^A-Za-z0-9_-]", "")
    return F.when(out == "", "output").otherwise(out)


def artifact_names(c: Column, ext: Column) -> list[Column]:
    f = family_name(c)
    return [F.concat(f, F.lit("_video."), ext).alias("video"), F.concat(f, F.lit("_detections.csv")).alias("detections"), F.concat(f, F.lit("_benchmark.csv")).alias("benchmark")]


def preview_quoted(c: Column) -> Column:
    return F.when(c == "", '""').when(c.rlike('[ \t"]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\"'), F.lit('"'))).otherwise(c)


def duration(seconds: Column) -> Column:
    """h:mm:ss or m:ss; -- unless positive."""
    t = F.floor(seconds).cast("int")
    h, m, s = F.floor(t / 3600).cast("int"), F.floor(t % 3600 / 60).cast("int"), t % 60
    return F.when(seconds <= 0, "--").when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def byte_size(n: Column) -> Column:
    v = n.cast("double")
    out = F.format_string("%.0f B", v)
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(v >= 1024.0**i, F.format_string(f"%.2f {unit}", v / 1024.0**i)).otherwise(out)
    return out


def bounded(c: Column, room: int) -> Column:
    """A string that fits ``room`` bytes with its end mark, else the empty one."""
    return F.when(F.octet_length(c) < room, c).otherwise(F.lit(""))


def truncated(c: Column, room: int) -> Column:
    """As much of a string (of one-byte characters) as fits ``room`` bytes with its end mark."""
    return F.substring(c, 1, max(room - 1, 0))


def mib(n: Column) -> Column:
    return n / F.lit(1048576.0)


def element_size(dtype: Column) -> Column:
    """Bytes of a tensor's element; 0 for a type that is not known."""
    return F.when(dtype.isin("fp32", "int32"), 4).when(dtype == "fp16", 2).when(dtype.isin("int8", "bool"), 1).otherwise(0)


def shape_text(dims: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(dims.cast("array<string>"), ","), F.lit("]"))


def numeric_prefix(c: Column) -> Column:
    """The number a report cell begins with; null if there is none."""
    return F.regexp_extract(c, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double")


#: words that put a line under the execution plan's topic (fixed values)
PLAN_WORDS = ("execution plan", "hardware profile", "fallback", "batch_size", "backend_batch", "inference_lane", "inflight_batches", "inference_context")


def classify(logs: DataFrame) -> DataFrame:
    low = F.lower("text")
    return logs.withColumns({
        "error": F.col("is_error") | low.contains("error") | low.contains("failed"), "warning": low.contains("warn"), "tensorrt": F.col("text").contains("TensorRT"),
        "plan": F.array_max(F.array(*[low.contains(w) for w in PLAN_WORDS])),
    })


def visible(logs: DataFrame, *, text: str = "", errors: bool = True, warnings: bool = True, tensorrt: bool = True, plan: bool = True) -> DataFrame:
    """Lines that hold ``text`` and are of no topic that is switched off."""
    out = classify(logs).filter(F.col("text").contains(text))
    for on, c in ((errors, "error"), (warnings, "warning"), (tensorrt, "tensorrt"), (plan, "plan")):
        out = out if on else out.filter(~F.col(c))
    return out


def fields_of(line: Column) -> Column:
    """The words of a line, in lower case; fields are words of the form key=value."""
    return F.split(F.trim(F.regexp_replace(F.lower(line), r"\s+", " ")), " ")


def field(words: Column, key: str) -> Column:
    """The number that the first field ``key`` begins with."""
    hit = F.try_element_at(F.filter(words, lambda w: w.startswith(key + "=")), F.lit(1))
    return numeric_prefix(F.substring(hit, len(key) + 2, 64))


#: keys of a machine progress line, of a plan line and of a hardware line (fixed values)
PROGRESS_FIELDS = "frame total_frames timestamp_ms duration_ms fps speed detections output_bytes".split()
HARDWARE_FIELDS = "batch_capacity inflight_batches inference_workers".split()
HARDWARE_REASON = "physical staged NVDEC -> inference -> output pipeline"
PLAN_FIELDS = (
    "execution_mode batch_size schedule_batch_size backend_batch_size inflight_batches total_active_frames active_frame_capacity frames_per_upload_batch frames_per_download_batch "
    "inference_context_count inference_lane_count pipeline_overlap_enabled parallel_inference_enabled vram_budget_mb estimated_batch_mb unused_vram_budget_mb reason"
).split()


def parsed(logs: DataFrame) -> DataFrame:
    """Lines with the fields found: machine progress (``kv``), plan field and value, human progress, hardware line."""
    t = F.col("text")
    kv = F.when(t.startswith("PROGRESS "), F.str_to_map(F.trim(F.substring(t, 10, 1 << 20)), F.lit(" "), F.lit("=")))
    key = F.regexp_extract(t, r"^\s*(\w+):", 1)
    is_plan = key.isin(PLAN_FIELDS)
    words = fields_of(t)
    at = F.array_position(words, "progress:").cast("int")
    fps = field(words, "wall_clock_fps")
    human = (at > 0) & (F.get(words, at) == "completed") & fps.isNotNull()
    hardware = F.array(*[field(words, k).cast("int") for k in HARDWARE_FIELDS])
    return logs.withColumns({
        "kv": kv, "plan_key": F.when(is_plan, key), "plan_value": F.when(is_plan, trim(F.regexp_replace(t, r"^\s*\w+:", ""))),
        "completed": F.when(human, numeric_prefix(F.get(words, at + 1)).cast("int")), "fps": F.when(human, fps),
        "hardware": F.when(F.lower(t).contains("hardware detection pipeline:") & F.forall(hardware, lambda x: x.isNotNull()), hardware),
    })


def latest(logs: DataFrame) -> DataFrame:
    """One row: the last values that any line gave. Aggregated by parts, so the log may be of any size."""
    p = parsed(logs)
    last = lambda c, when: F.max_by(c, F.when(when, F.col("line_no")))
    plan = [last(F.col("plan_value"), F.col("plan_key") == k).alias(k) for k in PLAN_FIELDS]
    return p.agg(F.max_by("text", "line_no").alias("last_line"), last(F.col("completed"), F.col("completed").isNotNull()).alias("completed"), last(F.col("fps"), F.col("fps").isNotNull()).alias("fps"), *plan)


def progress_state(logs: DataFrame) -> DataFrame:
    """One row: the state of a run after its log. Each field has the last value that a line of any kind gave.

    A field that does not parse leaves the one before. ``progress`` is the share of frames, or of time where the
    frames are not known, within 0 and 1. A hardware line also sets the fields that follow from its three.
    """
    p = parsed(logs)
    h = lambda i: F.get("hardware", F.lit(i))
    kv = lambda k, kind: numeric_prefix(F.try_element_at("kv", F.lit(k))).cast(kind)
    plan = lambda k, kind="int": F.when(F.col("plan_key") == k, numeric_prefix(F.col("plan_value")).cast(kind))
    flag = lambda k: F.when(F.col("plan_key") == k, F.lower("plan_value").isin("1", "true", "yes", "on"))
    given = {
        "frames_processed": F.coalesce(kv("frame", "int"), "completed"), "total_frames": kv("total_frames", "int"), "timestamp_ms": kv("timestamp_ms", "double"), "duration_ms": kv("duration_ms", "double"),
        "fps": F.coalesce(kv("fps", "double"), "fps"), "speed": kv("speed", "double"), "total_detections": kv("detections", "int"), "output_bytes": kv("output_bytes", "bigint"),
        "schedule_batch_size": F.coalesce(plan("schedule_batch_size"), h(0)), "batch_size": F.coalesce(plan("batch_size"), h(0)), "inflight_batches": F.coalesce(plan("inflight_batches"), h(1)),
        "inference_lane_count": F.coalesce(plan("inference_lane_count"), h(2)), "inference_context_count": F.coalesce(plan("inference_context_count"), h(2)),
        "total_active_frames": F.coalesce(plan("total_active_frames"), h(0) * h(1)), "active_frame_capacity": F.coalesce(plan("active_frame_capacity"), h(0) * h(1)),
        "pipeline_overlap_enabled": F.coalesce(flag("pipeline_overlap_enabled"), (h(1) > 1) | (h(2) > 1)), "parallel_inference_enabled": F.coalesce(flag("parallel_inference_enabled"), h(2) > 1),
        "fallback_reason": F.coalesce(F.when(F.col("plan_key") == "reason", F.col("plan_value")), F.when(F.col("hardware").isNotNull(), HARDWARE_REASON)),
    }
    out = p.agg(F.max_by("text", "line_no").alias("last_line"), *[F.max_by(c, F.when(c.isNotNull(), F.col("line_no"))).alias(k) for k, c in given.items()])
    share = F.when(F.col("total_frames") > 0, F.col("frames_processed") / F.col("total_frames")).when(F.col("duration_ms") > 0, F.col("timestamp_ms") / F.col("duration_ms"))
    return out.withColumn("progress", F.greatest(F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))


def eta(elapsed: Column, done: Column) -> Column:
    """(eta_seconds, total_seconds) of a share done."""
    going = (done > 0) & (done < 1)
    return F.struct(F.when(going, elapsed * ((1 - done) / done)).otherwise(F.lit(0.0)).alias("eta_seconds"), F.when(going, elapsed / done).when(done >= 1, elapsed).otherwise(F.lit(0.0)).alias("total_seconds"))


def tail(logs: DataFrame, n: int) -> DataFrame:
    """The last ``n`` lines."""
    return logs.orderBy(F.desc("line_no")).limit(n)
