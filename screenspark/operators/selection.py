"""Plan-time choice of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType

#: Columns that would leak the answer into a model, or only describe a row.
NOT_FEATURES = ("label", "status", "error", "warning", "rule_score", "pred_prob", "pseudo_label", "pseudo_score", "final_score", "rank")


def detect_column(df: DataFrame, preferences: list[str]) -> str | None:
    """The first preferred column that the table has."""
    return next((c for c in preferences if c in df.columns), None)


def model_features(df: DataFrame, exclude: tuple[str, ...] = NOT_FEATURES) -> list[str]:
    """Numeric columns that a model may learn from: no ids, paths, labels or leakage."""
    return sorted(f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in exclude and not f.name.endswith(("_id", "_path")))
