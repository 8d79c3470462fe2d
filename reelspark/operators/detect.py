"""From raw predictions to labelled detections: decode, select, suppress, label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAP = 300


def best_class(scores: Column, only: list[int] | None = None) -> Column:
    """(class_id, score) of the first largest positive score; among ``only``, in its order, if given. Null if none."""
    if only is None:
        top = F.array_max(scores)
        return F.when(top > 0, F.struct((F.array_position(scores, top) - 1).cast("int").alias("class_id"), top.alias("score")))
    listed = F.filter(F.array(*[F.struct(F.lit(c).alias("class_id"), F.try_element_at(scores, F.lit(c + 1)).alias("score")) for c in only if c >= 0]), lambda s: s["score"] > 0)
    top = F.array_max(F.transform(listed, lambda s: s["score"]))
    return F.try_element_at(F.filter(listed, lambda s: s["score"] == top), F.lit(1))


def decode(predictions: DataFrame, *, confidence: float = 0.25, only: list[int] | None = None, width: float = 640, height: float = 640, scale: float = 1.0, pad_x: float = 0.0, pad_y: float = 0.0) -> DataFrame:
    """Candidates (frame_index, prediction, class_id, confidence, x1, y1, x2, y2) in source pixels.

    Objectness must be positive and the confidence reach its threshold; a class list restricts the classes
    that compete. Boxes are clamped to the frame and empty ones dropped.
    """
    c = predictions.filter(F.col("obj") > 0).withColumn("b", best_class(F.col("scores"), only)).filter(F.col("b").isNotNull()).withColumn("confidence", F.col("obj") * F.col("b.score")).filter(F.col("confidence") >= confidence)
    edge = lambda mid, size, sign, pad, most: F.least(F.greatest((F.col(mid) + sign * F.col(size) * 0.5 - pad) / scale, F.lit(0.0)), F.lit(float(most)))
    boxes = c.select(
        "frame_index", "prediction", F.col("b.class_id").alias("class_id"), "confidence", edge("cx", "w", -1, pad_x, width).alias("x1"), edge("cy", "h", -1, pad_y, height).alias("y1"),
        edge("cx", "w", 1, pad_x, width).alias("x2"), edge("cy", "h", 1, pad_y, height).alias("y2"),
    )
    return boxes.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def iou(a, b) -> Column:
    """Intersection over union of two boxes (anything with fields x1..y2); 0 if the union is empty."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    area = lambda r: F.greatest(r["x2"] - r["x1"], F.lit(0.0)) * F.greatest(r["y2"] - r["y1"], F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def nms(candidates: DataFrame, *, threshold: float = 0.45, cap: int = CAP) -> DataFrame:
    """Greedy suppression in each frame, best first and by prediction number among equals.

    A candidate goes if a kept one of its class overlaps it by more than ``threshold``; a frame keeps ``cap``
    at most. One frame's candidates are bounded by the detector's outputs, so each is one array, folded
    without leaving the engine.
    """
    d = F.struct((-F.col("confidence")).alias("o"), "prediction", "class_id", "confidence", "x1", "y1", "x2", "y2")
    sorted_ = F.array_sort(F.collect_list(d))
    clash = lambda acc, x: F.exists(acc, lambda k: (k["class_id"] == x["class_id"]) & (iou(k, x) > threshold))
    folded = F.aggregate(F.col("ds"), F.slice("ds", 1, 0), lambda acc, x: F.when((F.size(acc) >= cap) | clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    kept = candidates.groupBy("frame_index").agg(sorted_.alias("ds")).select("frame_index", F.explode(folded).alias("d"))
    return kept.select("frame_index", "d.prediction", "d.class_id", "d.confidence", "d.x1", "d.y1", "d.x2", "d.y2")


def nms_arrow(candidates: DataFrame, *, threshold: float = 0.45, cap: int = CAP) -> DataFrame:
    """The same for frames of many thousand candidates, with numpy on each frame."""
    import numpy as np
    import pandas as pd

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "prediction"], ascending=[False, True], kind="stable")
        x1, y1, x2, y2, c = (pdf[k].to_numpy() for k in ("x1", "y1", "x2", "y2", "class_id"))
        area, alive, out = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0), np.ones(len(pdf), bool), []
        for i in range(len(pdf)):
            if not alive[i]:
                continue
            out.append(i)
            if len(out) == cap:
                break
            inter = np.maximum(np.minimum(x2[i], x2) - np.maximum(x1[i], x1), 0) * np.maximum(np.minimum(y2[i], y2) - np.maximum(y1[i], y1), 0)
            union = area[i] + area - inter
            alive &= ~((c == c[i]) & (np.divide(inter, union, out=np.zeros(len(pdf)), where=union > 0) > threshold))
        return pdf.iloc[out]

    return candidates.groupBy("frame_index").applyInPandas(keep, candidates.schema)


def with_names(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """class_name by class_id, empty without a label. A label file has one line a class: it is broadcast if its size is small."""
    names = labels.select(F.col("class_id").alias("__c"), F.col("class_name").alias("__n"))
    return detections.join(names, F.col("class_id") == F.col("__c"), "left").withColumn("class_name", F.coalesce("__n", F.lit(""))).drop("__c", "__n")


def csv_rows(detections: DataFrame) -> DataFrame:
    """The text of each field of the detections file."""
    six, three = (lambda c: F.format_string("%.6f", F.col(c).cast("double")).alias(c)), (lambda c: F.format_string("%.3f", F.col(c).cast("double")).alias(c))
    return detections.select("frame_index", six("timestamp_ms"), "class_id", "class_name", six("confidence"), *[three(c) for c in ("x1", "y1", "x2", "y2")])


def resolve_classes(ids: Column, names: Column, labels: DataFrame, base: DataFrame) -> DataFrame:
    """``base`` with ``resolved``: ids and then the ids of the names (trimmed, any case, first match), each once."""
    lookup = labels.groupBy(F.lower(F.trim("class_name")).alias("n")).agg(F.min("class_id").alias("c")).agg(F.map_from_entries(F.collect_list(F.struct("n", "c"))).alias("__m"))  # one label file
    found = F.transform(names, lambda x: F.try_element_at(F.col("__m"), F.lower(F.trim(x))))
    return base.crossJoin(F.broadcast(lookup)).withColumn("resolved", F.array_distinct(F.concat(ids, F.filter(found, lambda x: x.isNotNull())))).withColumn("unknown", F.size(F.filter(found, lambda x: x.isNull()))).drop("__m")


def output_shape(dims: Column, classes: Column) -> Column:
    """(predictions, transposed, attributes, class_offset) of a tensor's dims; null if no axis fits.

    5 + classes comes before 4 + classes, the last axis before the one before it.
    """
    n = F.size(dims)
    volume = F.aggregate(dims, F.lit(1).cast("long"), lambda a, d: a * d)
    last, prev = F.element_at(dims, -1), F.try_element_at(dims, F.lit(-2))
    volume = F.when(F.forall(dims, lambda d: d > 0), volume).otherwise(F.lit(0).cast("long"))
    out = F.lit(None)
    for add in (4, 5):
        a = classes + add
        shape = lambda count, t, a=a, add=add: F.struct(count.cast("int").alias("predictions"), F.lit(t).alias("transposed"), a.cast("int").alias("attributes"), F.lit(add).alias("class_offset"))
        out = F.when((last == a) & (volume >= a), shape(F.floor(volume / a), False)).when((n >= 2) & (prev == a) & (last > 0), shape(last, True)).otherwise(out)
    return out


def default_predictions(width: Column, height: Column) -> Column:
    """Predictions of a three-stride head with three anchors when the shape leaves them open."""
    cells = lambda s: F.floor(width / s) * F.floor(height / s)
    return (3 * (cells(8) + cells(16) + cells(32))).cast("int")


def read_outputs(outputs: DataFrame, classes: int) -> DataFrame:
    """Predictions (frame_index, prediction, cx, cy, w, h, obj, scores) of (frame_index, dims, output), in either layout.

    A tensor lists its predictions one after another or attribute by attribute; without an objectness of its
    own a prediction has 1. A shape that fits neither layout is an error.
    """
    shape = F.when(F.col("s").isNull(), F.raise_error(F.concat(F.lit("no detections in a tensor of "), F.array_join(F.col("dims").cast("array<string>"), "x")))).otherwise(F.col("s"))
    known = outputs.withColumn("s", output_shape(F.col("dims"), F.lit(classes))).withColumn("s", shape)
    rows = known.filter("s.predictions > 0").select("frame_index", "output", "s", F.explode(F.sequence(F.lit(0), F.col("s.predictions") - 1)).alias("prediction"))
    n, a = F.col("s.predictions"), F.col("s.attributes")
    at = lambda k: F.get("output", F.when(F.col("s.transposed"), k * n + F.col("prediction")).otherwise(F.col("prediction") * a + k)).cast("double")
    scores = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: at(F.col("s.class_offset") + c))
    obj = F.when(F.col("s.class_offset") == 4, F.lit(1.0)).otherwise(at(F.lit(4)))
    return rows.select("frame_index", "prediction", *[at(F.lit(k)).alias(c) for k, c in enumerate(("cx", "cy", "w", "h"))], obj.alias("obj"), scores.alias("scores"))


def looks_like_detections(dims: list[int]) -> bool:
    """Whether a tensor may hold detections: two axes or more, one of the last two with 5 to 4096 values."""
    return len(dims) >= 2 and all(d > 0 for d in dims) and any(5 <= d <= 4096 for d in dims[-2:])


def first_detections(value, depth: int = 4):
    """The first array in nested tuples and lists that looks like detections, at most ``depth`` levels down; else None."""
    if hasattr(value, "shape"):
        return value if looks_like_detections(list(value.shape)) else None
    if depth > 0 and isinstance(value, tuple | list):
        return next((x for v in value if (x := first_detections(v, depth - 1)) is not None), None)
    return None


def bounded_lists(detections: DataFrame, cap: int = CAP) -> DataFrame:
    """(frame_index, detections) with at most ``cap`` each, best first; a frame with more is an error, as nothing may be lost."""
    counted = detections.groupBy("frame_index").agg(F.count(F.lit(1)).alias("n"))
    fits = F.when(F.col("n") > cap, F.raise_error(F.concat(F.lit("frame "), F.col("frame_index").cast("string"), F.lit(f" has more than {cap} detections")))).otherwise(F.col("n"))
    checked = counted.withColumn("n", fits).filter(F.col("n") >= 0)
    d = F.struct((-F.col("confidence")).alias("o"), "prediction", "class_id", "confidence", "x1", "y1", "x2", "y2")
    listed = detections.join(checked, "frame_index").groupBy("frame_index").agg(F.array_sort(F.collect_list(d)).alias("d"))
    return listed.select("frame_index", F.transform("d", lambda x: x.dropFields("o")).alias("detections"))
