"""Statistics that merge: one small row for each part of a table and group, so that new files only add theirs.

Counts, sums and extremes are exact; quantiles come from KLL sketches and distinct counts from theta sketches, whose
sizes don't grow with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of the sketches, and the errors to expect of them at most (ranks: of all rows; distinct counts: of the count; both at some 99 %).
KLL_K = 400
RANK_ERROR = 0.015
THETA_BITS = 13
DISTINCT_ERROR = 0.04


def kept(rows: DataFrame, value: str, item: str, by: list[str]) -> DataFrame:
    """For each group of ``rows``: n, total, least, most, values (KLL sketch of ``value``), items (theta sketch of ``item``).

    Null values and items aren't counted; a group of nulls alone has n = 0, null total and extremes and empty sketches.
    Without groups in ``by`` the table is one. Append the rows of each new part to a table of them.
    """
    v = F.col(value).cast("double")
    return rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.kll_sketch_agg_double(v, F.lit(KLL_K)).alias("values"), F.theta_sketch_agg(item, F.lit(THETA_BITS)).alias("items"),
    )


def added(sketched: DataFrame, by: list[str]) -> DataFrame:
    """Rows of :func:`kept` by (fewer) groups: the same columns, as if made of all their parts' rows at once."""
    return sketched.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.kll_merge_agg_double("values", F.lit(KLL_K)).alias("values"), F.theta_union_agg("items", F.lit(THETA_BITS)).alias("items"),
    )


def merged(sketched: DataFrame, by: list[str], ranks: list[float]) -> DataFrame:
    """Statistics of groups from rows of :func:`kept`: n, total, mean, least, most, quantiles (at ``ranks``), n_distinct."""
    at = F.array(*[F.lit(float(r)) for r in ranks])
    quantiles = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("values", at))
    return added(sketched, by).select(*by, "n", "total", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"), "least", "most", quantiles.alias("quantiles"), F.theta_sketch_estimate("items").alias("n_distinct"))
