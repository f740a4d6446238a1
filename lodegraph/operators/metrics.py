"""Retrieval, localisation and answer metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

CUTS = (1, 5, 10)


def retrieval(ranked: DataFrame, truth: DataFrame, by: list[str] | None = None, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """One row for each query of ``truth`` (by..., gt array<id>), from ``ranked`` (by..., id, rank).

    mrr, and recall, hit, coverage and perfect at each cut. Ground truth is a set; an empty one has recall 0, hit 0 and
    perfect 1. Only relevant rows are joined, so the shuffle is as large as the ground truth, and counts give the rest.
    """
    by = by or ["qid"]
    want = truth.withColumn("gt", F.array_distinct("gt"))
    one = want.select(*by, F.explode("gt").alias("id"))
    best = ranked.select(*by, "id", "rank").join(one, [*by, "id"], "left_semi")
    best = best.groupBy(*by).agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in cuts])
    d = want.select(*by, F.size("gt").alias("n_gt")).join(best, by, "left")
    cols = {"mrr": F.coalesce(1 / F.col("first"), F.lit(0.0))}
    for k in cuts:
        n = F.coalesce(f"n{k}", F.lit(0))
        cols[f"recall{k}"] = n / F.greatest("n_gt", F.lit(1))
        cols[f"coverage{k}"] = cols[f"recall{k}"]
        cols[f"hit{k}"] = (n > 0).cast("double")
        cols[f"perfect{k}"] = (n == F.col("n_gt")).cast("double")
    return d.select(*by, "n_gt", *[c.alias(k) for k, c in cols.items()])


def averages(per_query: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Means over queries; a metric that a query lacks (null) does not count for it."""
    return per_query.groupBy(*(by or [])).agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("n_queries"))


def bucketed(per_query: DataFrame, metrics: list[str], bucket: str = "bucket") -> DataFrame:
    """Means by bucket and over all ('all')."""
    d = per_query.select(F.explode(F.array(F.col(bucket), F.lit("all"))).alias(bucket), *metrics)
    return averages(d, metrics, [bucket])


def ndcg(graded: DataFrame, by: list[str], k: int, rank: str = "rank", rel: str = "rel") -> DataFrame:
    """(by..., ndcg) with gain 2^rel - 1 and discount log2(rank + 1); 0 where nothing is relevant."""
    ideal = Window.partitionBy(*by).orderBy(F.desc(rel), rank)
    d = graded.withColumn("ideal", F.row_number().over(ideal))
    gain = F.pow(F.lit(2.0), F.col(rel)) - 1
    part = lambda r: F.sum(F.when(r <= k, gain / F.log2(r + 1)).otherwise(0.0))
    d = d.groupBy(*by).agg(part(F.col(rank)).alias("dcg"), part(F.col("ideal")).alias("best"))
    return d.select(*by, F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg"))


def cross_page_hit(gt_pages: Column, top_pages: Column) -> Column:
    """1 if all pages of the ground truth are among those of the top; null with one page or less."""
    pages = F.array_distinct(gt_pages)
    return F.when(F.size(pages) > 1, (F.size(F.array_except(pages, top_pages)) == 0).cast("double"))


def page_hit(gt_pages: Column, top_pages: Column) -> Column:
    """1 if a page of the ground truth is among those of the top."""
    return F.coalesce(F.arrays_overlap(gt_pages, top_pages), F.lit(False)).cast("double")


def average_precision(ranked: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n_gt, ap) for each query of ``truth`` (by..., gt): the mean, over the ground truth, of the precision at the rank of
    each relevant item; items that are not ranked count 0, and so does an empty ground truth.

    Only relevant rows are kept and numbered: the number of one among them over its rank is its precision.
    """
    by = by or ["qid"]
    want = truth.select(*by, F.array_distinct("gt").alias("gt"))
    hits = ranked.select(*by, "id", "rank").join(want.select(*by, F.explode("gt").alias("id")), [*by, "id"], "left_semi")
    hits = hits.withColumn("precision", F.row_number().over(Window.partitionBy(*by).orderBy("rank")) / F.col("rank"))
    d = want.select(*by, F.size("gt").alias("n_gt")).join(hits.groupBy(*by).agg(F.sum("precision").alias("sum")), by, "left")
    return d.select(*by, "n_gt", (F.coalesce("sum", F.lit(0.0)) / F.greatest("n_gt", F.lit(1))).alias("ap"))


def truncated(ranked: DataFrame, truth: DataFrame, most: int, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row for each query of ``truth`` (qid, gt): recall and hit at the cuts, and the reciprocal rank of the first hit
    among the ``most`` best, 0 without one. Ground truth is not empty."""
    one = truth.select("qid", F.size(F.array_distinct("gt")).alias("n_gt"), F.explode(F.array_distinct("gt")).alias("id"))
    d = one.join(ranked.filter(F.col("rank") <= most).select("qid", "id", "rank"), ["qid", "id"], "left")
    found = [F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in cuts]
    d = d.groupBy("qid", "n_gt").agg(F.min("rank").alias("first"), *found)
    cols = {f"recall{k}": F.col(f"n{k}") / F.col("n_gt") for k in cuts} | {f"hit{k}": (F.col(f"n{k}") > 0).cast("double") for k in cuts}
    return d.select("qid", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), *[c.alias(k) for k, c in cols.items()])


def target_recall(ranked: DataFrame, targets: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(n, hit at each cut) over queries with a target (qid, id); a target that is no candidate ranks behind all of them."""
    size = ranked.groupBy("qid").agg(F.count("*").alias("size"))
    d = targets.join(ranked.select("qid", "id", "rank"), ["qid", "id"], "left").join(size, "qid", "left")
    place = F.coalesce("rank", F.coalesce("size", F.lit(0)) + 1)
    return d.agg(F.count("*").alias("n"), *[F.avg((place <= k).cast("double")).alias(f"hit{k}") for k in cuts])


# Answers.


def normalised(text: Column) -> Column:
    """Lower case, no ASCII punctuation, single spaces."""
    marks = r"[!-/:-@\[-`{-~]"
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), marks, ""), r"[ \t\n\r\f\x0B]+", " "))


def exact_match(prediction: Column, truth: Column) -> Column:
    return (normalised(prediction) == normalised(truth)).cast("double")


def token_f1(prediction: Column, truth: Column) -> Column:
    """Shared distinct tokens over the lengths with repeats; 0 if either is empty or nothing is shared."""
    a, b = (F.filter(F.split(normalised(t), " "), lambda w: w != "") for t in (prediction, truth))
    both = F.size(F.array_intersect(a, b))
    p, r = both / F.size(a), both / F.size(b)
    return F.when(both > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def verdict(text: Column) -> Column:
    """A judge's word as a number: yes 1, partial 0.5, else 0."""
    t = F.lower(F.trim(text))
    return F.when(t.startswith("yes"), 1.0).when(t.startswith("partial"), 0.5).otherwise(0.0)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
