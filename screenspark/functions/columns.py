"""Null-safe column expressions. Missing numbers are NULL inside the engine, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of times in text.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
#: Texts that stand for a missing value.
NULL_TOKENS = ("nan", "none", "null", "na", "n/a")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """Trimmed text; null tokens and blanks become the empty string."""
    t = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.when(F.lower(t).isin(*NULL_TOKENS), F.lit("")).otherwise(t)


def finite(c: Column | str, default: float | None = None) -> Column:
    """The value as a double; what is not a finite number becomes ``default``."""
    v = F.expr("NULL").cast("double") if default is None else F.lit(float(default))
    d = col(c).try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), v).otherwise(d)


def clip(c: Column | str, lo: float | Column, hi: float | Column) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return F.when(col(c).isNull(), None).otherwise(F.greatest(lo, F.least(hi, col(c))))


def steady(c: Column | str) -> Column:
    """The value at nine digits: what orders and thresholds look at, so that sums that differ only by the order of their terms are equal."""
    return F.round(col(c), 9)


def time_or_min(c: Column | str) -> Column:
    """A time from text; what is missing or no time is the least one, so that it sorts before all others."""
    t = F.coalesce(*(F.try_to_timestamp(clean_text(c), F.lit(f)) for f in TIME_FORMATS), F.to_timestamp(F.lit("0001-01-01 00:00:00")))
    return t.cast("timestamp_ntz")


def first_nonempty(*cs: Column | str) -> Column:
    """The first non-empty cleaned text, else the empty string."""
    return F.coalesce(*(F.nullif(clean_text(c), F.lit("")) for c in cs), F.lit(""))


def token(c: Column | str) -> Column:
    """Lower-case token with dashes and spaces as underscores."""
    return F.regexp_replace(F.lower(clean_text(c)), "[- ]", "_")


def ratio(a: Column | str, b: Column | str, empty: float | None = None) -> Column:
    """a / b; ``empty`` where b is zero or NULL."""
    a, b = col(a), col(b)
    return F.when((b != 0) & b.isNotNull(), a.cast("double") / b.cast("double")).otherwise(F.lit(empty).cast("double"))


def weighted_available_mean(terms: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the terms that are not NULL, weights renormalised; NULL if there is none."""
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in terms), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in terms), F.lit(0.0))
    return F.when(weight > 0, top / weight)


def mean_of(*cs: Column) -> Column:
    """Mean of the values that are not NULL."""
    return weighted_available_mean([(c, 1.0) for c in cs])


def flags(*pairs: tuple[str, Column]) -> Column:
    """Names whose condition holds, in order, as an array."""
    return F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in pairs)))


def joined(c: Column, empty: str = "none", sep: str = ";") -> Column:
    """An array of texts as one text; ``empty`` if it has no element."""
    return F.when(F.size(c) == 0, F.lit(empty)).otherwise(F.array_join(c, sep))


def severity(c: Column | str, threshold: float) -> Column:
    """How far a proxy is over its threshold, 0 to 1; NULL counts as 0."""
    t = min(max(threshold, 0.0), 0.99)
    return F.when(col(c).isNull() | (col(c) <= t), 0.0).otherwise(clip((col(c) - t) / (1 - t), 0, 1))


def count_map(df, by: list[str], value: str, out: str):
    """``by`` and a map from each value to its number of rows; a null value is left out."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "_n")))).alias(out))
