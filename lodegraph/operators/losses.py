"""Training losses as aggregations over (anchor, candidate) rows with score s and relevance rel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ranking import nth_largest


def log_softmax(score: Column, by: list[str], tau: float = 1.0) -> Column:
    w = Window.partitionBy(*by)
    shifted = score / tau - F.max(score / tau).over(w)
    return shifted - F.log(F.sum(F.exp(shifted)).over(w))


def grcl(d: DataFrame, tau: float = 1.0) -> DataFrame:
    """(anchor, loss): cross entropy between normalised relevance and softmax; anchors without relevance have none."""
    d = d.withColumn("lp", log_softmax(F.col("s"), ["anchor"], tau))
    d = d.groupBy("anchor").agg(F.sum("rel").alias("all"), F.sum(F.col("rel") * F.col("lp")).alias("dot"))
    return d.filter("all > 0").select("anchor", (-F.col("dot") / F.col("all")).alias("loss"))


def info_nce(d: DataFrame, tau: float = 1.0, positive: float = 0.5) -> DataFrame:
    """GRCL with relevance cut to 0 or 1 at ``positive``."""
    return grcl(d.withColumn("rel", F.when(F.col("rel") >= positive, 1.0).otherwise(0.0)), tau)


def coverage(d: DataFrame, k: int = 5, eta: float = 10.0, strong: float = 0.5, weak: float = 0.1) -> DataFrame:
    """(anchor, loss): mean softplus(eta (theta - s)) of strong candidates, theta the k-th best weak score.

    Anchors without a strong candidate or with fewer than ``k`` weak ones have none.
    """
    theta = nth_largest(d.filter(F.col("rel") < weak), ["anchor"], k, "s")
    x = eta * (F.col("theta") - F.col("s"))
    soft = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    return d.filter(F.col("rel") >= strong).join(theta, "anchor").groupBy("anchor").agg(F.avg(soft).alias("loss"))


def consistency(d: DataFrame, tau: float = 1.0) -> DataFrame:
    """(anchor, loss): divergence of the softmax of ``dropped`` from that of ``s``."""
    d = d.withColumns({"lp": log_softmax(F.col("s"), ["anchor"], tau), "lq": log_softmax(F.col("dropped"), ["anchor"], tau)})
    return d.groupBy("anchor").agg(F.sum(F.exp("lp") * (F.col("lp") - F.col("lq"))).alias("loss"))


def total(g: Column, c: Column, k: Column) -> Column:
    return g + 0.3 * c + 0.5 * k
