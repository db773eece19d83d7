"""Best item of a group by weighted quality (W-01 to W-08, F-24)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config

METRICS = ("sharpness", "exposure", "contrast", "eyes_open")
# Wording of the reasons, in the order they are given.
FIRST, SHARPEST, OPEN, CLOSED, EXPOSED, CONTRASTED, NOTHING, BETWEEN = "종합 1위", "선명도 1위", "눈 뜸", "눈 감음 주의", "노출 양호", "대비 좋음", "—", " · "


def score_groups(metrics: DataFrame, cfg: Config | None = None, preset: str | None = None, rounded: int = 4) -> DataFrame:
    """metrics (group_id, file_id, sharpness, exposure, contrast, eyes_open, has_face) with preset, quality_score,
    is_best_shot and reason.

    Sharpness counts relative to the group's best (W-01, W-02). The preset is the one asked for if it is known, else person
    where any member shows a face, else landscape (W-03, A-15). Weights are renormalised over the metrics at hand (W-04); if
    they sum to nothing the plain mean counts. The best has the highest rounded score, then the smallest file id (W-05).
    """
    cfg = cfg or Config()
    group = Window.partitionBy("group_id")
    rows = metrics.withColumn("_max", F.coalesce(F.max("sharpness").over(group), F.lit(0.0)))
    rows = rows.withColumn("_sharp", F.when(F.col("_max") > 0, F.col("sharpness") / F.col("_max")).otherwise(0.0))
    if preset in cfg.quality_presets:
        chosen = F.lit(preset)
    else:
        chosen = F.when(F.bool_or(F.coalesce("has_face", F.lit(False))).over(group), "person").otherwise("landscape")
    rows = rows.withColumn("preset", chosen)

    def weight(name: str):
        out = F.lit(0.0)
        for p, w in cfg.quality_presets.items():
            out = F.when(F.col("preset") == p, float(w.get(name, 0.0))).otherwise(out)
        return out

    values = {"sharpness": F.col("_sharp"), "exposure": F.col("exposure"), "contrast": F.col("contrast"), "eyes_open": F.col("eyes_open")}
    there = {k: F.when(v.isNotNull(), 1.0).otherwise(0.0) for k, v in values.items()}
    total = sum((weight(k) * F.coalesce(v, F.lit(0.0)) for k, v in values.items()), F.lit(0.0))
    weights = sum((weight(k) * there[k] for k in values), F.lit(0.0))
    plain = sum((F.coalesce(v, F.lit(0.0)) for v in values.values()), F.lit(0.0)) / F.greatest(F.lit(1.0), sum(there.values(), F.lit(0.0)))
    rows = rows.withColumn("quality_score", F.round(F.when(weights > 0, total / F.when(weights > 0, weights)).otherwise(plain), rounded))
    best = F.row_number().over(group.orderBy(F.desc("quality_score"), "file_id")) == 1
    rows = rows.withColumn("is_best_shot", best)
    eyes = F.col("eyes_open")
    reason = F.concat_ws(
        BETWEEN,
        F.when(F.col("is_best_shot"), FIRST),
        F.when((F.col("_sharp") >= 0.999) & (F.col("_max") > 0), SHARPEST),
        F.when(eyes >= 0.5, OPEN).when(eyes.isNotNull(), CLOSED),
        F.when(F.col("exposure") >= 0.85, EXPOSED),
        F.when(F.col("contrast") >= 0.6, CONTRASTED),
    )
    return rows.withColumn("reason", F.when(reason == "", NOTHING).otherwise(reason)).drop("_max", "_sharp")


def detail_json(scored: DataFrame) -> DataFrame:
    """W-07: quality_detail as JSON with nulls written out."""
    detail = F.struct("preset", F.round("sharpness", 2).alias("sharpness"), F.round("exposure", 3).alias("exposure"), F.round("contrast", 3).alias("contrast"), "eyes_open", F.col("quality_score").alias("score"), "reason")
    return scored.withColumn("quality_detail", F.to_json(detail, {"ignoreNullFields": "false"}))


def best_shots(members: DataFrame, metrics: DataFrame, cfg: Config | None = None, preset: str | None = None) -> DataFrame:
    """W-08: members (group_id, file_id, ...) and metrics (file_id, ...) to quality columns; a member without metrics
    (its thumbnail is gone) counts with zeros and no face."""
    rows = members.select("group_id", "file_id").join(metrics, "file_id", "left")
    for m in ("sharpness", "exposure", "contrast"):
        rows = rows.withColumn(m, F.coalesce(m, F.lit(0.0)))
    return detail_json(score_groups(rows, cfg, preset)).select("group_id", "file_id", "quality_score", "is_best_shot", "quality_detail", "reason")


def reason_of(detail):
    """F-25: the reason in a detail JSON, empty where there is none or it is malformed."""
    return F.coalesce(F.get_json_object(detail, "$.reason"), F.lit(""))
