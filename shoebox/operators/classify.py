"""Rule classification over feature columns (I-10, P-11 to P-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config


def has_camera(make: Column, model: Column) -> Column:
    """P-11."""
    return (F.coalesce(make, F.lit("")) != "") | (F.coalesce(model, F.lit("")) != "")


def is_screen(width: Column, height: Column, cfg: Config) -> Column:
    """P-12: an exact known screen size, either way up."""
    sizes = sorted({tuple(sorted(s)) for s in cfg.screenshot_resolutions})
    size = F.concat_ws("x", F.least(width, height).cast("bigint"), F.greatest(width, height).cast("bigint"))
    return size.isin([f"{a}x{b}" for a, b in sizes])


def named_like(name: Column, cfg: Config) -> Column:
    """P-13: any of the patterns in the lower-cased name."""
    out = F.lit(False)
    for p in cfg.screenshot_name_patterns:
        out = out | F.contains(F.lower(name), F.lit(p))
    return out


def classify(df: DataFrame, cfg: Config | None = None) -> DataFrame:
    """df (name, make, model, width, height, white_ratio, edge_density, laplacian, brightness) with category and
    category_confidence; the first rule that holds decides."""
    cfg = cfg or Config()
    camera, white = has_camera(F.col("make"), F.col("model")), F.col("white_ratio")
    rules = [
        (named_like(F.col("name"), cfg), "screenshot", F.when(camera, 0.75).otherwise(0.95)),
        (~camera & is_screen(F.col("width"), F.col("height"), cfg), "screenshot", F.lit(0.70)),
        ((white >= cfg.document_white_ratio) & (F.col("edge_density") >= cfg.document_min_edge_density), "document", F.when(white > 0.7, 0.80).otherwise(0.60)),
        (F.col("laplacian") < cfg.blur_laplacian_threshold, "blurry", F.when(F.col("brightness") < cfg.blur_min_brightness, 0.40).otherwise(0.85)),
    ]
    category, confidence = F.lit("normal"), F.when(camera, 0.90).otherwise(0.60)
    for holds, kind, sure in reversed(rules):
        category = F.when(holds, kind).otherwise(category)
        confidence = F.when(holds, sure).otherwise(confidence)
    return df.withColumn("category", category).withColumn("category_confidence", confidence)
