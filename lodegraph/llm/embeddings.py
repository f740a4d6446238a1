"""Embedding near-dedup by Euclidean p-stable hashing with exact cosine checks."""

from __future__ import annotations

from math import ceil, erfc, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .arrays import groups, roots, whole_groups
from .blocks import in_blocks
from .common import components, join_spread, stored, with_group, without

#: Projections of a key and tables at least, the width of a projection's cells, the recall of pairs at the least cosine that
#: tables are chosen for, and the unrelated vectors that one may meet in all tables.
PROJECTIONS, TABLES, WIDTH, RECALL, STRANGERS = 12, 20, 2.0, 0.95, 64


def one_cell(cosine: float, width: float = WIDTH) -> float:
    """How often two unit vectors fall into one cell of one projection: 1 - 2 N(-w/d) - 2 d / (sqrt(2 pi) w) (1 - exp(-w^2 / 2 d^2)),
    d being their distance. For cosine 0.93 that is 0.85, for 0 it is 0.49."""
    r = width / sqrt(2 - 2 * cosine)
    return 1 - erfc(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def chosen(vectors: int, least: float = 0.93, width: float = WIDTH) -> tuple[int, int]:
    """(projections, tables) for a label of so many vectors: as many projections as keep a vector from meeting over ``STRANGERS``
    unrelated ones, and as many tables as then find ``RECALL`` of the pairs at the least cosine. Both grow with the
    logarithm of the label and a power of it below one, so pairs that meet in vain grow with the vectors and not their square."""
    near, far = one_cell(least, width), one_cell(0.0, width)
    projections = PROJECTIONS
    while True:
        tables = max(TABLES, ceil(log(1 - RECALL) / log(1 - near**projections)))
        if vectors * tables * far**projections <= STRANGERS:
            return projections, tables
        projections += 1


def usable():
    """Not null, not empty, no null or non-finite component, not zero."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0)


def hash_keys(unit: np.ndarray, seed: int, projections: int, tables: int, width: float) -> np.ndarray:
    """One 64-bit key for each vector and table: quantised random projections, hashed together."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    a = rng.standard_normal((unit.shape[1], tables * projections))
    cells = np.floor((unit @ a + rng.uniform(0, width, tables * projections)) / width).astype(np.int64).view(np.uint64)
    odd = rng.integers(0, 1 << 63, (tables, projections), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    key = (cells.reshape(len(unit), tables, projections) * odd).sum(axis=2)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def link_vectors(
    vectors: DataFrame,
    least: float = 0.93,
    projections: int | None = None,
    tables: int | None = None,
    width: float = WIDTH,
    seed: int = 11,
    block: int = 512,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    ``projections`` and ``tables`` are chosen by the vectors of the largest label where they are not given.

    Rows link if their labels are equal and not null, their vectors have one length, at least one table puts both in one
    bucket, and their cosine, in double precision, is ``least`` at least. Equal vectors of one label are one class from
    the start: their rows link with each other and with whatever the class links with, and buckets hold classes. A pair
    counts in the first table that it meets in. Buckets over ``block`` classes are compared in pairs of blocks, so no
    bucket is gathered in one task and none is capped.

    Vectors that are null, empty, zero, or hold a null, NaN or infinity link with nothing: n_links 0, themselves as
    component. Rows that repeat a vec_id count as rows; a null vec_id is left out of components (component_id null,
    kept false) but counts as a link. Extra columns are ignored. An empty table gives an empty table.
    """
    ship(vectors.sparkSession)
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label",
                       F.when(F.col("label").isNotNull() & usable(), F.transform("embedding", lambda x: x.cast("double") + 0.0)).alias("v"))
    good = d.filter("v IS NOT NULL")
    # A class is a vector under a label; its row is known by a hash of both with the vector's text behind it.
    good = good.withColumns({"class": F.xxhash64("label", "v", F.lit(3)), "class2": F.xxhash64(F.lit(5), "v", "label")})
    classes = stored(good.groupBy("class", "class2", "label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    classes = classes.withColumn("row", F.xxhash64("class", "label", "v"))
    if projections is None or tables is None:
        largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
        fitting = chosen(largest, least, width)
        projections, tables = projections or fitting[0], tables or fitting[1]

    def hashed(batches):
        for batch in batches:
            lengths = batch["v"].value_lengths().to_numpy()
            flat, ends = batch["v"].flatten().to_numpy(), np.append(0, np.cumsum(lengths))
            keys = np.zeros((len(lengths), tables), np.int64)
            for n in np.unique(lengths):
                own = np.flatnonzero(lengths == n)
                m = flat[(ends[own][:, None] + np.arange(n))]
                m = m / np.abs(m).max(axis=1, keepdims=True)
                keys[own] = hash_keys(m / np.linalg.norm(m, axis=1, keepdims=True), seed, projections, tables, width)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["label"], batch["copies"], batch["v"], keys], names=["row", "label", "copies", "v", "keys"])

    label = classes.schema["label"].dataType.simpleString()
    table = stored(classes.select("row", "label", "copies", "v").mapInArrow(
        hashed, f"row long, label {label}, copies long, v array<double>, keys array<bigint>"))
    light = table.select("row", "label", F.size("v").alias("n"), F.posexplode("keys").alias("table", "key"))
    light = light.select("row", "table", F.xxhash64("label", "n", "table", "key").alias("bucket"))
    met = with_group(light, "bucket", "row", {"count": F.count("*")}, {"count": F.sum}).filter("count > 1")
    met = met.withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    heavy = met.join(table.select("row", "copies", "v", "keys"), "row")
    heavy = in_blocks(heavy, F.col("bucket"), F.col("row"), F.col("blocks"))

    def compare(batches):
        for chunk in whole_groups(batches, "bk_key"):
            out = {"row": [], "links": [], "root": []}
            for g in groups(chunk, "bk_key"):
                row, copies, side = g["row"].to_numpy(), g["copies"].to_numpy(), g["bk_block"].to_numpy()
                v = g["v"].combine_chunks().flatten().to_numpy().reshape(len(row), -1)
                keys = g["keys"].combine_chunks().flatten().to_numpy().reshape(len(row), -1)
                v = v / np.abs(v).max(axis=1, keepdims=True)
                near = (v @ v.T) / np.outer(norm := np.linalg.norm(v, axis=1), norm) >= least
                np.fill_diagonal(near, False)
                if g["bk_low"][0].as_py() != g["bk_high"][0].as_py():
                    near &= side[:, None] != side
                for t in range(g["table"][0].as_py()):
                    near &= keys[:, t][:, None] != keys[:, t]
                if near.any():
                    a, b = np.nonzero(np.triu(near))
                    root = roots(len(row), a, b)
                    linked = np.flatnonzero(near.any(axis=1))
                    out["row"].append(row[linked])
                    out["links"].append(near[linked] @ copies)
                    out["root"].append(row[root[linked]])
            if out["row"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out.values()], names=list(out))

    need = heavy.select("bk_key", "bk_block", "bk_low", "bk_high", "table", "row", "copies", "v", "keys")
    links = stored(need.mapInArrow(compare, "row long, links long, root long"))
    counts = links.groupBy("row").agg(F.sum("links").alias("others"))
    ids = classes.select("row", "rep", "copies", "class", "class2")
    whole = components(links, "row", "root").join(ids.select(F.col("row").alias("id"), "rep"), "id")
    whole = with_group(whole, "root", "id", {"least": F.min("rep")}, {"least": F.min})
    found = ids.join(counts, "row", "left").join(whole.select(F.col("id").alias("row"), "least"), "row", "left")
    found = found.select("class", "class2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component"))
    # A class may have a third of all rows: it is told to them part by part. Two hashes of 64 bits stand for its vector.
    d = d.select("vec_id", *[F.when(F.col("v").isNotNull(), h).alias(k) for k, h in (
        ("class", F.xxhash64("label", "v", F.lit(3))), ("class2", F.xxhash64(F.lit(5), "v", "label")))])
    d = join_spread(d, found, ["class", "class2"], "vec_id")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return d.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                    F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def dedup_embeddings(vectors: DataFrame, **options) -> DataFrame:
    """The rows of ``vectors`` that stay: one of each component, and those with a null vec_id."""
    found = link_vectors(vectors, **options).filter("NOT kept AND vec_id IS NOT NULL").select("vec_id").distinct()
    return without(vectors).join(found, "vec_id", "left_anti")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m ON e.vec_id = m.a LEFT JOIN n ON e.vec_id = n.a
"""
