"""Embedding whitening: a covariance in tiles, its eigenvectors, and every vector projected on them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import stored

#: Dimensions of a tile's side, and rows of a row block.
WIDTH, ROWS = 32, 4096
#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): each usable vector's entries as whole numbers. Vectors that are null or empty, or hold an entry that
    is null, not finite or beyond 2^55 (whose x could pass a long), are not in it."""
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= 2.0**55))
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    d = d.filter(F.coalesce(F.size("v") > 0, F.lit(False)) & ~F.coalesce(odd, F.lit(True)))
    return d.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


@dataclass(frozen=True)
class Whitening:
    """What is learned of the fit list: ``n`` vectors of the column sums ``sums``, eigenvalues that fall, their unit
    eigenvectors as columns, the trace of the covariance, and the largest error of the whitened list's covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, where whole parts are taken off as whole numbers."""
        low = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.float64) / self.n
        return (x - low) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - sum)^2, exact; None where no long holds it."""
        low = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        away = x - low
        if float(self.n) ** 2 * (float(np.abs(away).max(initial=0)) + 1) ** 2 * max(x.shape[1], 1) < 2.0**62:
            return ((self.n * away - rest) ** 2).sum(axis=1).tolist()
        exact = (sum((self.n * a - r) ** 2 for a, r in zip(row, rest.tolist(), strict=True)) for row in away.tolist())
        return [e if e < 1 << 63 else None for e in exact]


def column_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension: a partial sum a task, in halves of 32 bits."""

    def partial(batches):
        n, high, low = 0, 0, 0
        for batch in batches:
            x = matrix(batch["x"])
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            columns = [np.arange(len(high)), high, low, np.full(len(high), n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["dim", "high", "low", "n"])

    parts = fit.mapInArrow(partial, "dim long, high long, low long, n long")
    rows = parts.groupBy("dim").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).orderBy("dim").collect()
    return (rows[0]["n"] if rows else 0), [(r["high"] << 32) + r["low"] for r in rows]


def tiled_covariance(fit: DataFrame, values: Callable, dims: int, n: int, width: int = WIDTH, rows: int = ROWS) -> np.ndarray:
    """The covariance, with divisor ``n``, of the centred rows that ``values`` makes of the column x.

    Dimensions are cut into blocks of ``width``; each two blocks are a tile. A row block sends each of its column blocks to
    the tiles that it is in, keyed by tile and row block; where two column blocks of a row block meet they are multiplied, and
    products are summed by tile, first in their task, then over tasks. The driver gets dims x dims numbers, however many
    rows there are.
    """
    blocks = -(-dims // width)
    tiles = [(a, b) for a in range(blocks) for b in range(a, blocks)]

    def column_blocks(batches):
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                c = values(matrix(batch["x"].slice(start, rows)))
                column = [np.ascontiguousarray(c[:, i * width : (i + 1) * width]).tobytes() for i in range(blocks)]
                for t, (a, b) in enumerate(tiles):
                    for side in sorted({a, b}):
                        yield pa.RecordBatch.from_pylist([{"tile": t, "block": task << 32 | k, "side": side, "data": column[side]}], schema)
                k += 1

    schema = pa.schema([("tile", pa.int32()), ("block", pa.int64()), ("side", pa.int32()), ("data", pa.binary())])
    summed = pa.schema([("tile", pa.int32()), ("data", pa.binary())])

    def breadth(i: int) -> int:
        return min(width, dims - i * width)

    def told(t: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"tile": t, "data": total.tobytes()}], summed)

    def multiply(batches):
        at, total, left = None, None, None
        for batch in batches:
            for t, side, data in zip(batch["tile"].to_pylist(), batch["side"].to_pylist(), batch["data"].to_pylist(), strict=True):
                if t != at:
                    if at is not None:
                        yield told(at, total)
                    a, b = tiles[t]
                    at, total = t, np.zeros((breadth(a), breadth(b)))
                block = np.frombuffer(data).reshape(-1, breadth(side))
                if a == b:
                    total += block.T @ block
                elif side == a:
                    left = block
                else:
                    total += left.T @ block
        if at is not None:
            yield told(at, total)

    def add(batches):
        at, total = None, None
        for batch in batches:
            for t, data in zip(batch["tile"].to_pylist(), batch["data"].to_pylist(), strict=True):
                part = np.frombuffer(data)
                if t == at:
                    total = total + part
                else:
                    if at is not None:
                        yield told(at, total)
                    at, total = t, part
        if at is not None:
            yield told(at, total)

    pieces = fit.mapInArrow(column_blocks, "tile int, block long, side int, data binary")
    products = pieces.repartition("tile", "block").sortWithinPartitions("tile", "block", "side").mapInArrow(multiply, "tile int, data binary")
    whole = products.repartition("tile").sortWithinPartitions("tile").mapInArrow(add, "tile int, data binary")
    out = np.zeros((dims, dims))
    for t, data in whole.collect():
        a, b = tiles[t]
        part = np.frombuffer(data).reshape(breadth(a), breadth(b)) / n
        out[a * width : a * width + len(part), b * width : b * width + part.shape[1]] = part
        out[b * width : b * width + part.shape[1], a * width : a * width + len(part)] = part.T
    return out


def fit_whitening(numbers: DataFrame, components: int = 16, width: int = WIDTH) -> Whitening | None:
    """Learn from each distinct vector of (vec_id, x) once; None where there is no vector.

    Components whose variance is zero, to double precision, have an eigenvalue of 0 and no whitened values.
    """
    ship(numbers.sparkSession)
    fit = stored(numbers.select("x").distinct())
    n, sums = column_sums(fit)
    if not n:
        return None
    plain = Whitening(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    v = tiled_covariance(fit, plain.centred, len(sums), n, width)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    values = np.where(values > max(values[0], 0) * len(sums) * np.finfo(float).eps, values, 0.0)
    model = Whitening(n, sums, values, vectors, float(np.trace(v)))
    have = int((values > 0).sum())
    if have:
        used = replace(model, values=values[:have], vectors=vectors[:, :have])
        error = np.abs(tiled_covariance(fit, used.whitened, have, n, width) - np.eye(have)).max()
        model = replace(model, identity_error=float(error))
    return model


def whiten(vectors: DataFrame, components: int = 16, width: int = WIDTH) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each usable vector and component.

    Vectors that are null, empty, or hold a null or a non-finite entry (or one beyond 2^55) are left out. So are vectors of
    another length than the most frequent among distinct ones (of equally frequent lengths the smallest counts). Rows that
    repeat a vector are in the fit list once, and each has its rows in the result; rows that repeat a vec_id too, and those
    with a null one. A component without variance has a null ``whitened`` and explains 0; ``deviation`` is null where no
    long holds it. With fewer dimensions there are fewer components. Equal eigenvalues leave their components' plane
    free; it is the same for all rows. Extra columns are ignored. An empty table, or one without a usable vector, gives an
    empty table.
    """
    numbers = whole_numbers(vectors)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = numbers.select("x").distinct().groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    numbers = numbers.filter(F.size("x") == lengths["size"])
    model = fit_whitening(numbers, components, width)
    k, have = len(model.values), int((model.values > 0).sum())
    used = replace(model, values=model.values[:have], vectors=model.vectors[:, :have])
    explained = np.where(model.values > 0, model.values / (model.trace or 1.0), 0.0)

    def project(batches):
        for batch in batches:
            x = matrix(batch["x"])
            m = len(x)
            w = np.full((m, k), np.nan)
            w[:, :have] = used.whitened(x)
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"].take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return numbers.mapInArrow(project, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
