"""Approximate aggregates as sketches that are stored per day and rolled up without the rows behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^12 registers: a standard error of about 1.6 % in distinct counts.
HLL_BITS = 12
#: Size of the quantile sketches: a rank error of about 1.3 % with 99 % confidence.
KLL_K = 200
#: Items that a frequency sketch follows.
TRACKED = 1024


def daily(rows: DataFrame, keys: list[str], *, time: str, item: str, value: str, label: str) -> DataFrame:
    """One row per day and keys: n, and mergeable sketches of distinct items, of the quantiles of value, and of frequent labels.

    One pass with partial aggregation: a busy key sends a sketch per task. Null items, values and labels are not in the sketches.
    """
    return rows.groupBy(F.to_date(time).alias("day"), *keys).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(item, F.lit(HLL_BITS)).alias("items"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("values"),
        F.expr(f"approx_top_k_accumulate(`{label}`, {TRACKED})").alias("labels"),
    )


def rolled(sketches: DataFrame, by: list, *, quantiles: tuple[float, ...] = (0.5, 0.9), top: int = 3) -> DataFrame:
    """Sketches of any days and keys merged: n, distinct (estimate), quantiles (array of estimates) and top (label and count, the most frequent first)."""
    merged = sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("values", KLL_K).alias("values"), F.expr(f"approx_top_k_combine(labels, {TRACKED})").alias("labels")
    )
    at = F.array(*[F.lit(float(q)) for q in quantiles])
    kept = [c for c in merged.columns if c not in ("items", "values", "labels")]
    return merged.select(*kept, F.hll_sketch_estimate("items").alias("distinct"), F.kll_sketch_get_quantile_double("values", at).alias("quantiles"), F.expr(f"approx_top_k_estimate(labels, {top})").alias("top"))
