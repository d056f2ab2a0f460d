"""Queries: pseudo labels, preparation, training and cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenspark.operators import model as m
from screenspark.plans import views as v
from screenspark.plans.registry import register
from screenspark.plans.staging import stage

COLS = ["anchor_hit_fraction", "mouth_occlusion", "site_distance"]
_W = {"site_hit_fraction": (1, 0.16), "anchor_hit_fraction": (1, 0.14), "mouth_occlusion": (1, 0.12), "site_distance": (-1, 0.08), "energy_gb": (-1, 0.05)}
_RAW = v.mean_sql([(f"s_{c}" if s > 0 else f"1 - s_{c}", w) for c, (s, w) in _W.items()])


@register("ml1_pseudo_labels", v.with_sql(v.ITEMS, v.scaled_ctes("items", "z", list(_W)), f"p AS (SELECT item, greatest(0, least(1, {_RAW})) AS raw, round(greatest(0, least(1, {_RAW})), 9) AS s FROM z)", select="SELECT item, round(raw, 6) AS pseudo_score, CASE WHEN (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2) / count(*) OVER () >= 0.7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pseudo_label FROM p"))
def ml1_pseudo_labels(spark, sf_dir):
    return m.pseudo_labels(v.items(spark, sf_dir), "top_fraction", 0.3).select("item", "pseudo_score", "pseudo_label")


_F = ", ".join(f"(SELECT median({c}) FROM items WHERE candidate % 4 <> 0) AS md_{c}" for c in COLS)
_Z = ", ".join(f"avg(coalesce({c}, md_{c})) AS m_{c}, stddev_samp(coalesce({c}, md_{c})) AS d_{c}" for c in COLS)
_O = ", ".join(f"round((coalesce({c}, md_{c}) - m_{c}) / d_{c}, 6) AS z_{c}" for c in COLS)


@register("ml3_prepare", v.with_sql(v.ITEMS, f"md AS (SELECT {_F})", f"ft AS (SELECT {_Z} FROM items, md WHERE candidate % 4 <> 0)", select=f"SELECT item, {_O} FROM items, md, ft"))
def ml3_prepare(spark, sf_dir):
    d = v.items(spark, sf_dir)
    fitted = m.fit_prep(d.filter("candidate % 4 <> 0"), COLS)
    return m.apply_prep(d, fitted, COLS).select("item", *(f"z_{c}" for c in COLS))


@register("ml5_train_and_predict")
def ml5_train_and_predict(spark, sf_dir):
    """A model of three quarters of the candidates, applied to all items."""
    d = stage(v.items(spark, sf_dir), "items")
    tr = d.filter("candidate % 4 <> 0")
    fitted = m.fit_prep(tr, COLS)
    model = m.train(m.apply_prep(tr, fitted, COLS), COLS)
    return m.predict(model, m.apply_prep(d, fitted, COLS), COLS).select("item", "pred_prob", "pred_logit", "top_contributions")


@register("ml4_soft_targets")
def ml4_soft_targets(spark, sf_dir):
    """A model of soft targets from the pseudo score."""
    used = [c for c in m.PSEUDO_FEATURES if c in _W]
    d = stage(m.pseudo_labels(v.items(spark, sf_dir).select("item", *used)).select("item", *COLS, "pseudo_score"), "pseudo")
    fitted = m.fit_prep(d, COLS)
    p = m.apply_prep(d, fitted, COLS)
    return m.predict(m.train(p, COLS, soft="pseudo_score"), p, COLS).select("item", "pred_prob", F.col("pseudo_score"))


def validated_items(spark, sf_dir):
    """The items' columns that a cross-validation looks at."""
    return v.ranked_items(spark, sf_dir, "label")


@register("ml6_cross_validate")
def ml6_cross_validate(spark, sf_dir):
    return m.cross_validate(validated_items(spark, sf_dir), COLS)


@register("ml6_fold_summary")
def ml6_fold_summary(spark, sf_dir):
    """Metrics over the folds, with the rule's scaling fitted on the training rows."""
    return m.fold_summary(m.cross_validate(validated_items(spark, sf_dir), COLS, fit_on="train"))
