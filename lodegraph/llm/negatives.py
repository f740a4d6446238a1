"""Hard-negative mining: an exact nearest-neighbour join over a Voronoi partition of the anchors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import ship
from .arrays import mixed
from .common import stored

#: Components are compared as floor(SCALE * x).
SCALE = 256
#: Anchors that a task holds at most, candidates of one slice of a group, and entries of one product.
ANCHORS, SLICE, ENTRIES = 4096, 200_000, 1 << 21
#: Pivots at most, and rows whose exact scores tell how far a row that still counts can be.
PIVOTS, GUIDES = 2048, 2048
BANDS = pa.list_(pa.struct([("id", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))
ANY = 1 << 62


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q, norm): rows that take part, their components as whole numbers and the sum of their squares.

    Rows with a null vec_id, label or vector, an empty vector, or a component that is null or not finite don't, nor do those
    whose sum of squares reaches 2^62, as a score of theirs may pass a long. Of rows that repeat a vec_id the one of the
    smallest label, then vector, does; of vectors of several lengths those of the most frequent (then smallest) length do.
    """
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= 2.0**31))
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    d = d.filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(v) > 0").filter(~F.coalesce(odd, F.lit(True)))
    d = d.withColumn("q", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")))
    squares = F.aggregate("q", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    d = d.filter(squares < 2.0**62).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("m")).select("vec_id", "m.*")
    d = stored(d.withColumn("norm", F.aggregate("q", F.lit(0).cast("long"), lambda s, c: s + c * c)))
    length = d.groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return d if length is None else d.filter(F.size("q") == length["n"])


@dataclass(frozen=True)
class Pivots:
    """Rows that cells of the anchors are around. A row stands at its vector with sqrt(``most`` - norm) behind it, an anchor
    with 0 behind it: a larger inner product with an anchor is then a smaller distance, whatever the norms. Guides are more
    such rows: the last of the best ones among them bounds what an anchor can still ask for."""

    q: np.ndarray
    most: int
    guide_ids: np.ndarray
    guide_labels: np.ndarray
    guides: np.ndarray

    @property
    def kind(self) -> type:
        """Numbers in which each product and each sum of products is exact."""
        return np.float32 if self.most < 1 << 24 else np.float64 if self.most < 1 << 53 else np.int64

    @property
    def stored_as(self) -> type:
        return np.int16 if self.most < 1 << 30 else np.int32

    @property
    def slack(self) -> float:
        """Above the rounding error of any distance below."""
        return 1e-6 * max(self.most, 1) ** 0.5

    def norms(self, q: np.ndarray) -> np.ndarray:
        return (q.astype(np.float64) ** 2).sum(axis=1)

    def of_rows(self, q: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots."""
        back, own = (np.sqrt(np.maximum(self.most - self.norms(m), 0)) for m in (q, self.q))
        dot = q.astype(np.float64) @ self.q.T.astype(np.float64) + np.outer(back, own)
        return np.sqrt(np.maximum(2.0 * self.most - 2 * dot, 0))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        dot = q.astype(np.float64) @ self.q.T.astype(np.float64)
        return np.sqrt(np.maximum(self.norms(q)[:, None] + self.most - 2 * dot, 0))

    def distance(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far from an anchor a row of this score is."""
        return np.sqrt(np.maximum(self.norms(q) + self.most - 2.0 * score, 0))


def choose_pivots(rows: DataFrame, anchors: DataFrame) -> Pivots:
    """Half the square root of the anchors' number, ``PIVOTS`` at most, and ``GUIDES`` guides: rows of the smallest hashes of
    their ids. Both bound the search only; results don't hang on which rows they are."""
    n = max(1, min(PIVOTS, round(anchors.count() ** 0.5 / 2)))
    most = rows.agg(F.max("norm")).first()[0] or 0
    held = rows.orderBy(F.xxhash64("vec_id", F.lit(12)), "vec_id").limit(max(n, GUIDES)).collect()
    q = np.array([r["q"] for r in held], np.int64).reshape(len(held), len(held[0]["q"]) if held else 0)
    ids, labels = (np.array([r[c] for r in held], np.int64) for c in ("vec_id", "label"))
    return Pivots(q[:n], most, ids, labels, q)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def agree(a: np.ndarray, b: np.ndarray, same: bool) -> np.ndarray:
    return (a[:, None] == b[None, :]) == same


def in_cells(anchors: DataFrame, pivots: Pivots, best: int, same: bool) -> DataFrame:
    """``anchors`` (vec_id, label, q, bands) with their cell, their distance to its pivot, and the distances that rows which
    can still serve them lie between: a band's least score, or that of the last of the ``best`` guides in it, and its greatest."""

    def placed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q, ids, labels = matrix(batch["q"]), batch["vec_id"].to_numpy(), batch["label"].to_numpy()
            away = pivots.of_anchors(q)
            cell = away.argmin(axis=1)
            ends = batch["bands"].value_lengths().to_numpy()
            of = np.repeat(np.arange(len(q)), ends)
            low, high = (batch["bands"].flatten().field(i).to_numpy() for i in (1, 2))
            # Scores of guides, exact, where they may be an anchor's results.
            least = low.copy()
            for start in range(0, len(of) if len(pivots.guides) >= best else 0, 512):
                part = slice(start, start + 512)
                own, where = np.unique(of[part], return_inverse=True)
                s = (q[own].astype(pivots.kind) @ pivots.guides.T.astype(pivots.kind))[where]
                fits = agree(labels[of[part]], pivots.guide_labels, same) & (ids[of[part], None] != pivots.guide_ids[None, :])
                s = np.where(fits & (s >= low[part, None]) & (s <= high[part, None]), s, -ANY)
                least[part] = np.maximum(low[part], np.partition(s, -best, axis=1)[:, -best].astype(np.int64))
            lowest, highest = np.full(len(q), ANY), np.full(len(q), -ANY)
            np.minimum.at(lowest, of, least)
            np.maximum.at(highest, of, high)
            far = np.where(lowest <= -ANY, np.inf, pivots.distance(q, lowest))
            near = np.where(highest >= ANY, 0.0, pivots.distance(q, highest))
            own = away[np.arange(len(q)), cell]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in ("vec_id", "label", "q", "bands")], pa.array(cell.astype(np.int32)), pa.array(own), pa.array(far), pa.array(near)],
                names=["vec_id", "label", "q", "bands", "cell", "own", "far", "near"])

    kept = "vec_id long, label long, q array<bigint>, bands array<struct<id:bigint,low:bigint,high:bigint>>"
    return anchors.select("vec_id", "label", "q", "bands").mapInArrow(placed, f"{kept}, cell int, own double, far double, near double")


JOINED = "key long, side int, vec_id long, label long, q binary, bands array<struct<id:bigint,low:bigint,high:bigint>>"
SIDES = pa.schema([("key", pa.int64()), ("side", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64()), ("q", pa.binary()), ("bands", BANDS)])


def packed(q: np.ndarray, kind: type) -> pa.Array:
    q = np.ascontiguousarray(q.astype(kind))
    width = q.shape[1] * q.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(q), [None, pa.py_buffer(q)]).cast(pa.binary())


def join_near(rows: DataFrame, anchors: DataFrame, pivots: Pivots, best: int, same: bool) -> DataFrame:
    """(anchor, band, vec_id, score, rank): for each band of each anchor the first ``best`` rows of the band, by falling score,
    then vec_id, whose label is the anchor's (``same``, the anchor aside) or is not.

    Anchors lie in the cell of their nearest pivot. A row goes to the cells that it might serve: where its distance to the
    pivot, less the cell's radius, is not above the farthest distance that an anchor there asks for, and with the radius
    not below the nearest one. Cells of many anchors are cut into groups, and each group meets its rows in slices, whose
    results are ranked once more.
    """
    cells = stored(in_cells(anchors, pivots, best, same))
    told = cells.groupBy("cell").agg(F.max("own").alias("radius"), F.max("far").alias("far"), F.min("near").alias("near"), F.count("*").alias("n"))
    told = sorted(told.collect())
    slices = max(1, -(-rows.count() // SLICE))
    parts = [-(-t["n"] // ANCHORS) for t in told]
    first = np.cumsum([0, *parts]).tolist()
    at, begin, share = np.array([t["cell"] for t in told], np.int64), np.array(first), np.array(parts, np.uint64)
    kind = pivots.stored_as

    def sent(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q, m = matrix(batch["q"]), batch.num_rows
            cell = np.searchsorted(at, batch["cell"].to_numpy())
            group = begin[cell] + (mixed(batch["vec_id"].to_numpy().view(np.uint64)) % share[cell]).astype(np.int64)
            for s in range(slices):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group * slices + s), pa.array(np.zeros(m, np.int32)), batch["vec_id"], batch["label"], packed(q, kind), batch["bands"]],
                    schema=SIDES)

    radius, far, near = (np.array([t[c] for t in told]) for c in ("radius", "far", "near"))

    def routed(batches):
        for batch in batches:
            if not batch.num_rows or not len(at):
                continue
            q = matrix(batch["q"])
            away = pivots.of_rows(q)[:, at]
            serves = (away - radius <= far + pivots.slack) & (away + radius >= near - pivots.slack)
            data, own = packed(q, kind), batch["slice"].to_numpy()
            for c in np.flatnonzero(serves.any(axis=0)):
                here = np.flatnonzero(serves[:, c])
                take = pa.array(here)
                for group in range(first[c], first[c + 1]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group * slices + own[here]), pa.array(np.ones(len(here), np.int32)), batch["vec_id"].take(take), batch["label"].take(take), data.take(take), pa.nulls(len(here), BANDS)],
                        schema=SIDES)

    exact = pivots.kind

    def meet(batches):
        group = None
        for batch in batches:
            key, side = batch["key"].to_numpy(), batch["side"].to_numpy()
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if group is None or group.key != key[a]:
                    if group is not None:
                        yield group.results()
                    group = Group(int(key[a]), best, same, exact, kind)
                if side[a] == 0:
                    group.ask(part)
                else:
                    group.meet(part)
        if group is not None:
            yield group.results()

    ask = cells.select("vec_id", "label", "q", "bands", "cell").mapInArrow(sent, JOINED)
    offer = rows.select("vec_id", "label", "q", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(slices)).cast("long").alias("slice")).mapInArrow(routed, JOINED)
    both = ask.union(offer).repartition("key").sortWithinPartitions("key", "side")
    found = both.mapInArrow(meet, "anchor long, band long, vec_id long, score long")
    order = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


class Group:
    """Anchors of one group, and for each of their bands the best rows met so far."""

    def __init__(self, key: int, best: int, same: bool, exact: type, kind: type):
        self.key, self.best, self.same, self.exact, self.kind = key, best, same, exact, kind
        self.asked: list[pa.RecordBatch] = []
        self.q = None

    def ask(self, part: pa.RecordBatch) -> None:
        self.asked.append(part)

    def numbers(self, part: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(part["q"].to_pylist()), self.kind).reshape(part.num_rows, -1).astype(self.exact)

    def start(self) -> None:
        self.ids, self.labels = (np.concatenate([p[c].to_numpy() for p in self.asked]) for c in ("vec_id", "label"))
        self.q = np.concatenate([self.numbers(p) for p in self.asked])
        self.of = np.repeat(np.arange(len(self.ids)), np.concatenate([p["bands"].value_lengths().to_numpy() for p in self.asked]))
        self.band, self.low, self.high = (np.concatenate([p["bands"].flatten().field(i).to_numpy() for p in self.asked]) for i in range(3))
        self.least = self.low.copy()
        # Results so far, in any order: number of the band, score, id.
        self.held = [np.zeros(0, np.int64) for _ in range(3)]

    def meet(self, part: pa.RecordBatch) -> None:
        if not self.asked:
            return
        if self.q is None:
            self.start()
        step = max(1, ENTRIES // max(len(self.ids), len(self.of), 1))
        for a in range(0, part.num_rows, step):
            rows = part.slice(a, step)
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            scores = self.q @ self.numbers(rows).T
            fits = agree(self.labels, labels, self.same) & (self.ids[:, None] != ids[None, :])
            s = scores[self.of]
            hit, row = np.nonzero(fits[self.of] & (s >= self.least[:, None]) & (s <= self.high[:, None]))
            if not len(hit):
                continue
            new = (hit, s[hit, row].astype(np.int64), ids[row])
            band, score, of = (np.concatenate(x) for x in zip(self.held, new, strict=True))
            order = np.lexsort((of, -score, band))
            band, score, of = band[order], score[order], of[order]
            begin = np.append(True, band[1:] != band[:-1])
            place = np.arange(len(band)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
            full = place == self.best - 1
            self.least[band[full]] = np.maximum(self.low[band[full]], score[full])
            self.held = [x[place < self.best] for x in (band, score, of)]

    def results(self) -> pa.RecordBatch:
        band, score, ids = self.held if self.q is not None else [np.zeros(0, np.int64)] * 3
        columns = [self.ids[self.of[band]], self.band[band], ids, score] if self.q is not None else [ids] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "band", "vec_id", "score"])


def mine_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20)
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows of (vec_id, embedding, label).

    A row's score is the inner product of its and the anchor's components as whole numbers, floor(256 x); higher ones come
    first, equal ones by vec_id. Anchors are the rows where ``anchors`` holds. Positives of an anchor are the first
    ``positives`` other rows of its label; negatives of an anchor and a positive the first ``negatives`` rows of another
    label whose score is at least ``low`` and at most ``high`` of the positive's, as fractions (both ends included; under a
    negative score there are none). Where there are fewer, all are taken; ranks are from 1.

    ``taking_part`` tells which rows take part, and what happens to nulls, odd numbers and repeated rows. Extra columns are
    ignored. An empty table, or one without anchors, gives an empty table.
    """
    ship(vectors.sparkSession)
    rows = taking_part(vectors)
    chosen = rows.filter(F.coalesce(anchors, F.lit(False)))
    pivots = choose_pivots(rows, chosen)
    band = lambda i, a, b: F.struct(i.cast("long").alias("id"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    every = F.array(band(F.lit(0), F.lit(-ANY), F.lit(ANY)))
    near = stored(join_near(rows, chosen.withColumn("bands", every), pivots, positives, True))
    p = F.col("score").cast("decimal(38,0)")
    least, most = F.ceil(p * low[0] / low[1]), F.floor(p * high[0] / high[1])
    near = near.select(F.col("anchor"), F.col("vec_id").alias("positive"), F.col("score").alias("positive_score"), least.cast("long").alias("least"), most.cast("long").alias("most"))
    bands = near.filter("least <= most").groupBy("anchor").agg(F.array_sort(F.collect_list(band(F.col("positive"), F.col("least"), F.col("most")))).alias("bands"))
    asking = chosen.join(bands, F.col("vec_id") == F.col("anchor")).drop("anchor")
    far = join_near(rows, asking, pivots, negatives, False)
    out = far.join(near.select("anchor", F.col("positive").alias("band"), "positive_score"), ["anchor", "band"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("band").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
                      "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_negatives(moved, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
