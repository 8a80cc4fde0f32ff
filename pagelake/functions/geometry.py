"""Pixels and regions as Column expressions. Points are structs of x and y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Annotation types, their page-layout types, and the places of the stages' texts.
REGION_TYPES = ("marginalia", "interlinear", "underline", "strikethrough", "circling", "symbol", "unclassified")
STAGE_INDEX = {"raw": 0, "cleaned": 1, "translated": 2}


def restored(points: Column, model_w: Column, model_h: Column, width: Column, height: Column) -> Column:
    """Points of a resized image in the original's pixels: each axis by its own scale, half to even, inside the bounds."""
    bad = F.least(model_w, model_h, width, height) <= 0
    axis = lambda v, size, model: F.least(size.cast("int"), F.greatest(F.lit(0), F.bround(v.cast("double") * (size / model.cast("double"))).cast("int")))
    out = F.transform(points, lambda p: F.struct(axis(p["x"], width, model_w).alias("x"), axis(p["y"], height, model_h).alias("y")))
    return F.when(bad, F.raise_error("image dimensions must be positive").cast("array<struct<x:int,y:int>>")).otherwise(out)


def bbox(points: Column) -> Column:
    """struct<x0,y0,x1,y1> around points; nulls for none."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def crop_bounds(points: Column, padding: float, width: Column, height: Column) -> Column:
    """Box of the points cut to whole pixels, widened by a share of its own size and kept inside the image."""
    whole = F.transform(points, lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y")))
    b = bbox(whole)
    pad = lambda lo, hi: F.bround((b[hi] - b[lo]).cast("double") * padding).cast("int")
    return F.struct(
        F.greatest(F.lit(0), b["x0"] - pad("x0", "x1")).alias("x0"), F.greatest(F.lit(0), b["y0"] - pad("y0", "y1")).alias("y0"),
        F.least(width.cast("int"), b["x1"] + pad("x0", "x1")).alias("x1"), F.least(height.cast("int"), b["y1"] + pad("y0", "y1")).alias("y1"),
    )


def box_points(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))])


def component_type(w: Column, h: Column, deviation: Column, cx: Column, cy: Column, ink_above: Column, text: Column) -> Column:
    """'underline' for a thin, wide, level stroke below ink, 'marginalia' outside the text's box, else 'unclassified'."""
    stroke = h.between(2, 12) & (w / h.cast("double") >= 5.0) & (deviation <= 20.0) & ink_above
    outside = (cx < text["x0"]) | (cx > text["x1"]) | (cy < text["y0"]) | (cy > text["y1"])
    return F.when(stroke, "underline").when(F.coalesce(outside, F.lit(False)), "marginalia").otherwise("unclassified")


def page_type(kind: Column) -> Column:
    return F.when(kind == "marginalia", "marginalia").otherwise("other")


def custom_of(kind: Column) -> Column:
    return F.concat(F.lit("structure {type:"), F.when(kind.isin(*REGION_TYPES), kind).otherwise("unclassified"), F.lit(";}"))


def numbered(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.lpad(n.cast("string"), 4, "0"))


def stage_text(equivs: Column, stage: str) -> Column:
    return F.get(F.filter(equivs, lambda e: e["index"] == STAGE_INDEX[stage]), F.lit(0))["unicode"]


def with_stage_text(equivs: Column, stage: str, text: Column) -> Column:
    """Texts with one stage's replaced, in order of their index."""
    new = F.struct(F.lit(STAGE_INDEX[stage]).alias("index"), text.alias("unicode"))
    return F.array_sort(F.array_append(F.filter(equivs, lambda e: e["index"] != STAGE_INDEX[stage]), new))


def fitted(width: Column, height: Column, longest: int = 1288) -> Column:
    """struct<w,h> with the longest edge cut to `longest`; smaller images stay."""
    scale = longest / F.greatest(width, height).cast("double")
    cut = lambda v: F.when(scale < 1, F.greatest(F.lit(1), F.bround(v * scale).cast("int"))).otherwise(v.cast("int"))
    return F.struct(cut(width).alias("w"), cut(height).alias("h"))
