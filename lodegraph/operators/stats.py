"""Summaries, histograms, reports and paired tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .linking import hash_order


def seven_numbers(x: str = "x") -> list[Column]:
    """Mean, deviation (of the population), quartiles and ends."""
    p = lambda q: F.percentile(x, F.lit(q))
    return [F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), p(0.5).alias("median"), p(0.25).alias("p25"),
            p(0.75).alias("p75"), F.min(x).alias("low"), F.max(x).alias("high")]


def upper_median(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """The value at place n // 2 of each group, sorted, from 0. Values are counted first, so a group may be large."""
    n = df.groupBy(*by, x).count()
    w = Window.partitionBy(*by).orderBy(x)
    n = n.withColumns({"upto": F.sum("count").over(w), "size": F.sum("count").over(Window.partitionBy(*by))})
    return n.filter(F.col("upto") > F.floor(F.col("size") / 2)).groupBy(*by).agg(F.min(x).alias("median"))


def cut_counts(x: Column, cuts: tuple[float, ...]) -> list[Column]:
    return [F.count_if(x >= c).alias(f"ge_{str(c).replace('.', '_')}") for c in cuts]


def pivot(long: DataFrame, row: list[str], names: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """A column for each of the given names; the names are given, so no extra job finds them."""
    return long.groupBy(*row).pivot(name, names).agg(F.first(value))


def report(wide: DataFrame, row: list[str], names: list[str]) -> DataFrame:
    """A Markdown line for each row, of percentages; a dash where there is no value."""
    cell = [F.coalesce(F.format_string("%5.1f", F.round(F.col(n) * 100, 6)), F.lit("-")) for n in names]
    return wide.select(*row, F.concat(F.lit("| "), F.concat_ws(" | ", *row, *cell), F.lit(" |")).alias("line"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Differences of two runs, query by query; only keys that both have."""
    return a.select(*keys, F.col(value).alias("va")).join(b.select(*keys, F.col(value).alias("vb")), keys).withColumn(
        "diff", F.col("va") - F.col("vb"))


def bootstrap(diffs: DataFrame, key: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """(n, mean, lo, hi, p): mean of ``diff`` and its 95 % interval from means of resamples.

    Each resample draws n of the n pairs with replacement: draw j of resample b takes the pair at a hash of (b, j) modulo
    n, of the pairs in the order of ``key``. Draws of one pair are counted before they meet it, so what is joined has a row
    for each (resample, pair) drawn. Pairs are one row for each query and are numbered in one task.
    """
    at = F.row_number().over(Window.orderBy(key)) - 1
    d = diffs.select("diff", at.alias("at"))
    n = diffs.agg(F.count("*").alias("n"), F.avg("diff").alias("mean"))
    draws = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    draws = draws.filter("n > 0").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10)
    draws = draws.groupBy("b", (drawn.cast("long") % F.col("n")).alias("at")).count()
    means = draws.join(d, "at").groupBy("b").agg((F.sum(F.col("diff") * F.col("count")) / F.sum("count")).alias("m"))
    d = means.agg(F.sort_array(F.collect_list("m")).alias("m")).crossJoin(n)  # one row with one
    lo, hi = int(0.025 * resamples), int(0.975 * resamples) - 1
    against = F.size(F.filter("m", lambda x: F.when(F.col("mean") >= 0, x <= 0).otherwise(x >= 0)))
    return d.select("n", "mean", F.get("m", F.lit(lo)).alias("lo"), F.get("m", F.lit(hi)).alias("hi"),
                    F.least(F.lit(1.0), 2 * against / resamples).alias("p"))


def best_step(log: DataFrame, by: list[str], metric: str = "value", step: str = "step") -> DataFrame:
    """The first step at which the metric is at its highest."""
    return log.groupBy(*by).agg(F.min(F.struct((-F.col(metric)).alias("v"), step)).alias("b")).select(
        *by, F.col(f"b.{step}").alias(step), (-F.col("b.v")).alias(metric))


def tumbling(log: DataFrame, by: list[str], width: int = 20, step: str = "step") -> DataFrame:
    """Means of ``value`` over each ``width`` steps."""
    return log.groupBy(*by, F.floor((F.col(step) - 1) / width).alias("window")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def warm_up(step: Column, warmup: int) -> Column:
    return F.least(step / F.lit(float(warmup)), F.lit(1.0))


def bytes_text(n: Column) -> Column:
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for unit, size in (("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30)):
        out = F.when(n >= size, F.format_string(f"%.1f {unit}", n / float(size))).otherwise(out)
    return out


def config_gaps(declared: DataFrame, defined: DataFrame) -> DataFrame:
    """Names on one side only, with the side."""
    return declared.exceptAll(defined).withColumn("side", F.lit("declared")).union(defined.exceptAll(declared).withColumn("side", F.lit("defined")))


def sample(rows: DataFrame, n: int, seed: int, *names: str) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the same on every run: those of the smallest seeded hashes of the named
    columns. Spark keeps ``n`` of each partition and merges those."""
    return rows.orderBy(hash_order(seed, *names), *names).limit(n)


def sample_each(rows: DataFrame, by: list[str], n: int, seed: int, *names: str) -> DataFrame:
    """``place`` from 1, for exactly ``n`` rows of each group (all, if it has fewer). Each partition keeps ``n`` of a group before
    rows are shuffled."""
    w = Window.partitionBy(*by).orderBy(hash_order(seed, *names), *names)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
