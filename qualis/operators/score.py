"""Quality score: 100 minus weighted points lost per issue category.

Per category the largest affected ratio counts; points lost are
round(min(w, 3 * w * ratio), 2); the score is clamped to [0, 100] and rounded to
one decimal. Points are summed as decimals so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT_CONFIG, QUALITY_LABELS, QualityConfig


def _weight(cfg: QualityConfig):
    pairs = []
    for k, v in cfg.weights.items():
        pairs += [F.lit(k), F.lit(float(v))]
    return F.coalesce(F.create_map(*pairs)[F.col("category")], F.lit(float(cfg.default_weight)))


def quality_breakdown(issues: DataFrame, cfg: QualityConfig = DEFAULT_CONFIG) -> DataFrame:
    """category, points_lost (decimal(10,2)), only categories that lose points."""
    ratio = issues.groupBy("category").agg(F.max("affected_ratio").alias("ratio"))
    w = _weight(cfg)
    lost = F.round(F.least(w, w * F.col("ratio") * 3), 2).cast("decimal(10,2)")
    return (ratio.select("category", lost.alias("points_lost"))
            .where(F.col("points_lost") > 0).orderBy(F.desc("points_lost"), "category"))


def _label(score):
    expr = None
    for threshold, label in QUALITY_LABELS:
        expr = (F.when(score >= threshold, label) if expr is None
                else expr.when(score >= threshold, label))
    return expr.otherwise("Poor")


def quality_score(issues: DataFrame, cfg: QualityConfig = DEFAULT_CONFIG) -> DataFrame:
    """One row: score DOUBLE, label STRING, points_lost DECIMAL."""
    lost = quality_breakdown(issues, cfg).agg(
        F.coalesce(F.sum("points_lost"), F.lit(0).cast("decimal(10,2)")).alias("points_lost"))
    raw = F.round(F.lit(100).cast("decimal(10,2)") - F.col("points_lost"), 1)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw.cast("double")))
    return lost.select(score.alias("score"), "points_lost").select(
        "score", _label(F.col("score")).alias("label"), "points_lost")
