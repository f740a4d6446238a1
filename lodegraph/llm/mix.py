"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import documents, n_words, stored, without

WEIGHTS = (5, 2, 1)


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """(mx_null, mx_src, source_size) -> the same with ``target``.

    ``share`` of all sizes is dealt to the sources by weight; no target passes ``cap`` times its source's size, and what
    it cannot take is dealt again among the others. Closed form: with sources in the order of cap / weight, the first k
    are full, where k is the first at which the next source would not be full.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("mx_null", "mx_src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("mx_i") % len(weights)).cast("int") + 1)
    t = sizes.withColumn("mx_i", F.row_number().over(order) - 1).withColumn("mx_w", w)
    full = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("mx_w"), "mx_i")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(F.lit(0))
    t = (
        t.withColumn("mx_c", F.lit(cap) * F.col("source_size"))
        .withColumn("mx_total", F.lit(share) * F.sum("source_size").over(everyone))
        .withColumn("mx_cb", F.coalesce(F.sum("mx_c").over(before), F.lit(0.0)))
        .withColumn("mx_wa", F.sum("mx_w").over(full.rowsBetween(0, Window.unboundedFollowing)))
    )
    # The level (target per weight) if all sources before this one are full and this one is not.
    t = t.withColumn("mx_level", (F.col("mx_total") - F.col("mx_cb")) / F.col("mx_wa"))
    t = t.withColumn("mx_open", F.col("mx_level") * F.col("mx_w") < F.col("mx_c"))
    level = F.min(F.when(F.col("mx_open"), F.struct("mx_i0", "mx_level"))).over(everyone)["mx_level"]
    t = t.withColumn("mx_i0", F.row_number().over(full)).withColumn("mx_at", level)
    target = F.least(F.col("mx_c"), F.coalesce(F.col("mx_at") * F.col("mx_w"), F.col("mx_c")))
    return t.select("mx_null", "mx_src", "source_size", target.alias("target"))


def _part(doc_id: Column, text: Column, parts: int) -> Column:
    """Which of the parts a document falls into: by a hash of its id, without one of its text."""
    known = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), text), F.lit(""))
    return F.conv(F.substring(F.md5(known), 1, 8), 16, 10).cast("long") % parts


def magnitude(size: Column) -> Column:
    """Digits of a size and its two leading ones: documents of one class differ by a tenth at most."""
    text = size.cast("string")
    return F.length(text) * 100 + F.substring(text, 1, 2).cast("int")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
    parts: int = 1024,
) -> DataFrame:
    """Documents with ``size``, ``source_size``, ``target`` and ``copies``, the times that the mix takes each.

    Within a source every document expects target / source_size copies. Documents stand in the order of their size
    class, so that any stretch of them is alike; the sum of expected copies up to each, plus one random offset for the
    source, crosses an integer where the document is emitted. The running sum is a rank times a rate, and ranks come
    from counts of (source, size class, part), so no source is gathered in one task.

    Null text has size 0 and empty text too; a source of size 0 takes nothing. Null sources form one source, the last.
    Rows without an id are dealt by their texts. Documents of one size are no tie: they stand by part and id. Rows that
    repeat are documents of their own. A very long text is a size like others. The table of sources, one row each, is
    ranked in one task. Input columns named like an output are replaced.
    An empty table gives an empty mix.
    """
    d = without(docs, "size", "source_size", "target", "copies").withColumns({
        "size": n_words(F.col("text")),
        "mx_null": F.col("source").isNull(),
        "mx_src": F.coalesce(F.col("source"), F.lit("")),
        "mx_part": _part(F.col("doc_id"), F.col("text"), parts),
    })
    d = d.withColumn("mx_class", magnitude(F.col("size")))
    keys = ["mx_null", "mx_src", "mx_class", "mx_part"]
    cells = stored(d.groupBy(*keys).agg(F.count("*").alias("mx_n"), F.sum("size").alias("mx_size")))
    # Ranks: within (source, class) over parts, then within the source over classes; both tables are small.
    classes = cells.groupBy("mx_null", "mx_src", "mx_class").agg(
        F.sum("mx_n").alias("mx_n"), F.sum("mx_size").alias("mx_size")
    )
    sources = classes.groupBy("mx_null", "mx_src").agg(F.sum("mx_size").alias("source_size"))
    goals = source_targets(sources, weights, share, cap)
    by_class = Window.partitionBy("mx_null", "mx_src").orderBy("mx_class")
    classes = classes.withColumn("mx_before", F.sum("mx_n").over(by_class) - F.col("mx_n")).drop("mx_n", "mx_size")
    classes = classes.join(goals, ["mx_null", "mx_src"])
    by_part = Window.partitionBy("mx_null", "mx_src", "mx_class").orderBy("mx_part")
    cells = cells.withColumn("mx_in", F.sum("mx_n").over(by_part) - F.col("mx_n")).drop("mx_n", "mx_size")
    cells = cells.join(classes, ["mx_null", "mx_src", "mx_class"])
    inside = Window.partitionBy(*keys).orderBy("size", "doc_id")
    d = d.withColumn("mx_row", F.row_number().over(inside)).join(cells, keys)
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col("mx_null").cast("string"), F.lit(":"), F.col("mx_src")))
    offset = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.col("mx_before") + F.col("mx_in") + F.col("mx_row")
    copies = F.floor(upto * rate + offset) - F.floor((upto - 1) * rate + offset)
    d = d.withColumn("copies", F.least(copies, F.lit(int(cap))).cast("long"))
    return d.drop(*keys, "mx_before", "mx_in", "mx_row")


def take(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as its ``copies`` say."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mix_sources(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, source IS NULL AS n, coalesce(source, '') AS s,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
k AS (SELECT *, length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT AS c,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text ' || text, '')), 1, 8))::BIGINT % 1024 AS p FROM d),
src AS (SELECT n, s, sum(size)::BIGINT AS source_size FROM d GROUP BY n, s),
i AS (SELECT *, row_number() OVER (ORDER BY n, s) - 1 AS i FROM src),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(i % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS c FROM i),
f AS (SELECT *, row_number() OVER (ORDER BY source_size / w, i) AS r,
             1.5::DOUBLE * sum(source_size) OVER () AS total,
             coalesce(sum(c) OVER (ORDER BY source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS cb,
             sum(w) OVER (ORDER BY source_size / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wa FROM w),
l AS (SELECT arg_min((total - cb) / wa, r) AS level FROM f WHERE (total - cb) / wa * w < c),
g AS (SELECT n, s, source_size, least(c, coalesce(level * w, c)) AS target,
             ('0x' || substr(md5('7:' || n::VARCHAR || ':' || s), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM f, l),
r AS (SELECT k.doc_id, k.size, g.source_size, g.target, g.u,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
             row_number() OVER (PARTITION BY k.n, k.s ORDER BY k.c, k.p, k.size, k.doc_id NULLS FIRST) AS x
      FROM k JOIN g ON k.n = g.n AND k.s = g.s)
SELECT doc_id, size, source_size, target,
       (least(floor(x * rate + u) - floor((x - 1) * rate + u), 2) * size)::BIGINT AS taken
FROM r
"""
