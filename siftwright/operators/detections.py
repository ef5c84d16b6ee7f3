"""Boxes of detectors: overlap, non-maximum suppression, squaring, selection.

Suppression is greedy per image; an image contributes at most ``candidates`` boxes (the detector's own documented limit,
applied by a window before they are gathered), so the fold over them is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")


def iou(a: list[Column], b: list[Column], inclusive: bool = False) -> Column:
    """Intersection over union of two boxes given by corner columns; 0 for boxes without area."""
    add = 1.0 if inclusive else 0.0
    side = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo + add)
    common = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    area = lambda c: side(c[0], c[2]) * side(c[1], c[3])
    return F.coalesce(F.try_divide(common, area(a) + area(b) - common), F.lit(0.0))


def suppress(boxes: DataFrame, threshold: float, image: str = "image", candidates: int = 200, inclusive: bool = False, most: int | None = None) -> DataFrame:
    """Kept boxes per image: best first (ties by box_id), boxes that overlap a kept one too much go.

    Greedy order is a fold over the image's sorted boxes, at most ``candidates`` of them; ``inclusive`` counts pixels,
    ``most`` keeps that many of the best.
    """
    best = Window.partitionBy(image).orderBy(F.desc("score"), "box_id")
    pool = boxes.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= candidates)
    listed = pool.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("_rn", F.struct(*boxes.columns).alias("b")))).alias("l"))
    rows = F.transform("l", lambda x: x["b"])
    corners = lambda x: [x[c].cast("double") for c in CORNERS]
    step = lambda kept, x: F.when(F.exists(kept, lambda k: iou(corners(k), corners(x), inclusive) > threshold), kept).otherwise(F.concat(kept, F.array(x)))
    none = F.slice(rows, 1, 0)
    kept = F.aggregate(rows, none, step)
    kept = kept if most is None else F.slice(kept, 1, most)
    return listed.select(F.explode(kept).alias("b")).select("b.*")


def select_detections(boxes: DataFrame, least: float, threshold: float = 0.5, label: str | None = None) -> DataFrame:
    """Boxes (fractions of the image) above a probability, suppressed, in whole pixels of ``width`` and ``height``.

    With ``label`` the boxes of each label are suppressed among themselves.
    """
    likely = boxes.where(F.col("score") > least)
    if label is None:
        kept = suppress(likely, threshold)
    else:
        kept = suppress(likely.withColumn("_of", F.struct("image", label)), threshold, "_of").drop("_of")
    scaled = {"x1": F.col("x1") * F.col("width"), "y1": F.col("y1") * F.col("height"), "x2": F.col("x2") * F.col("width"), "y2": F.col("y2") * F.col("height")}
    return kept.withColumns({k: v.cast("int") for k, v in scaled.items()})


def grid_faces(cells: DataFrame, least: float = 0.7, threshold: float = 0.45, height_factor: float = 1.25) -> DataFrame:
    """Square face boxes from centre-form grid cells (image, box_id, cx, cy, w, h, score) and letterbox columns
    (scale, pad_w, pad_h, width, height)."""
    clip = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top.cast("double"))
    x = lambda sign: clip((F.col("cx") + sign * F.col("w") / 2 - F.col("pad_w")) / F.col("scale"), F.col("width"))
    y = lambda sign: clip((F.col("cy") + sign * F.col("h") / 2 - F.col("pad_h")) / F.col("scale"), F.col("height"))
    corner = cells.where(F.col("score") > least).select("image", "box_id", "score", "width", "height", x(-1).alias("x1"), y(-1).alias("y1"), x(1).alias("x2"), y(1).alias("y2"))
    kept = suppress(corner, threshold)
    half = (F.col("y2") - F.col("y1")) * height_factor / 2
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return kept.withColumns({"x1": clip(cx - half, F.col("width")), "y1": clip(cy - half, F.col("height")), "x2": clip(cx + half, F.col("width")), "y2": clip(cy + half, F.col("height"))})


def squared(box: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """A box array grown on its shorter side to a square, cut at the image when its size is given."""
    w, h = box[2] - box[0], box[3] - box[1]
    longest = F.greatest(w, h)
    dx, dy = ((longest - w) / 2).cast("int"), ((longest - h) / 2).cast("int")
    grown = [box[0] - dx, box[1] - dy, box[2] + dx, box[3] + dy]
    if width is not None and height is not None:
        grown = [F.greatest(F.lit(0), grown[0]), F.greatest(F.lit(0), grown[1]), F.least(width, grown[2]), F.least(height, grown[3])]
    return F.array(*grown)


def largest_face(boxes: DataFrame, image: str = "image") -> DataFrame:
    """The largest box of every image, its centre, and whether it fills more than half of the image."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    best = boxes.groupBy(image).agg(F.max_by(F.struct(*CORNERS, "width", "height", area.alias("area")), F.struct(area, -F.col("box_id"))).alias("b"))
    b = F.col("b")
    return best.select(image, ((b["x1"] + b["x2"]) / 2).alias("cx"), ((b["y1"] + b["y2"]) / 2).alias("cy"), (b["area"] > 0.5 * b["width"] * b["height"]).alias("is_headshot"))


def per_image(boxes: DataFrame, image: str = "image") -> DataFrame:
    """Detections of every image as one sorted list."""
    return boxes.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("box_id", *CORNERS, "score"))).alias("detections"))


def mask_pixels(logits: DataFrame, threshold: float, dilate: int, key: str = "image") -> DataFrame:
    """Pixels (key, x, y) that any label's logit (key, label, x, y, logit) marks, grown by ``dilate`` pixels to all sides.

    A probability counts from the threshold on in steps of 1/255, as in a mask of bytes.
    """
    marked = logits.where(F.floor(255 / (1 + F.exp(-F.col("logit")))) > int(threshold * 255)).select(key, "x", "y").distinct()
    steps = [F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-dilate, dilate + 1) for dy in range(-dilate, dilate + 1)]
    grown = marked.select(key, "x", "y", F.explode(F.array(*steps)).alias("d"))
    return grown.select(key, (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y")).distinct()


def blackened(pixels: DataFrame, mask: DataFrame, value: str, key: str = "image") -> DataFrame:
    """Pixels (key, x, y, value) with 0 where the mask covers them."""
    joined = pixels.join(mask.withColumn("_masked", F.lit(True)), [key, "x", "y"], "left")
    return joined.withColumn(value, F.when(F.col("_masked"), 0).otherwise(F.col(value))).drop("_masked")
