"""Operators on whole tables of embeddings against plain versions in numpy and Python."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, rank string, extra int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA).repartition(parts)


def odd(v):
    return not v or any(c is None or not math.isfinite(c) for c in v)


def made(n=150, dims=7, seed=5):
    r = random.Random(seed)
    centre = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [float(np.float32(c + r.gauss(0, 0.4))) for c in r.choice(centre)], r.randrange(4)) for i in range(n)]
    rows += [(n + i, rows[3][1], i % 3) for i in range(40)]
    rows += [(900, None, 1), (901, [], 1), (902, [1.0, None] + [0.0] * (dims - 2), 1), (903, [math.nan] * dims, 1),
             (904, [math.inf] * dims, 2), (905, [0.0] * dims, 2), (906, [1.0], 0), (950, rows[5][1], None), (None, rows[6][1], 1)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [2, 7, 32])
def test_whitening(spark, width):
    rows, dims = made(), 7
    out = whitening.whiten(frame(spark, rows), components=5, width=width).collect()
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v, _ in rows if not odd(v) and len(v) == dims}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    centred = np.array([[float(c - m) for c, m in zip(v, mean, strict=True)] for v in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(out) == 5 * len(x)
    got = {(r.vec_id, r.component): r for r in out}
    assert set(got) == {(i, k) for i in x for k in range(1, 6)}
    sign = {}
    for (i, k), r in got.items():
        away = np.array([float(c - m) for c, m in zip(x[i], mean, strict=True)])
        assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[i], sums, strict=True))
        want = away @ vectors[:, k - 1] / math.sqrt(values[k - 1])
        sign.setdefault(k, 1 if r.whitened * want >= 0 or abs(want) < 1e-6 else -1)
        assert abs(r.whitened * sign[k] - want) < 1e-7
        assert abs(r.explained - values[k - 1] / np.trace(cov)) < 1e-9 and 0 <= r.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    none = frame(spark, [(1, None, 1), (2, [math.nan], 1)])
    assert whitening.whiten(none).count() == 0 and whitening.whiten(none.limit(0)).count() == 0
    # One distinct vector, many times: no variance.
    same = whitening.whiten(frame(spark, [(i % 3, [1.0, 2.0], 1) for i in range(9)])).collect()
    assert len(same) == 18 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, 0.0, 0.0)}
    # A dimension that never moves has no component; very large entries keep exact deviations, or none.
    flat = whitening.whiten(frame(spark, [(i, [float(i), 5.0], 1) for i in range(6)])).collect()
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True}
    large = whitening.whiten(frame(spark, [(1, [2.0**33], 1), (2, [0.0], 1), (3, [1e36], 1)])).collect()
    assert {r.vec_id for r in large} == {1, 2} and all(r.deviation is None for r in large)
    mid = whitening.whiten(frame(spark, [(1, [2.0**20], 1), (2, [0.0], 1)])).collect()
    assert {r.deviation for r in mid} == {(1 << 26) ** 2} and {round(abs(r.whitened), 9) for r in mid} == {1.0}


def mined(rows, positives=5, k=3):
    x = {}
    for i, v, label in rows:
        if i is not None and label is not None and not odd(v):
            one = (label, [math.floor(256 * c) for c in v])
            x[i] = min(x.get(i, one), one)
    size = max(set(sizes := [len(v) for _, v in x.values()]), key=lambda s: (sizes.count(s), -s))
    x = {i: (label, v) for i, (label, v) in x.items() if len(v) == size}
    out = []
    for a, (label, v) in x.items():
        if a % 10:
            continue
        score = {i: sum(p * q for p, q in zip(v, w, strict=True)) for i, (_, w) in x.items()}
        order = sorted((i for i in x if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in order if x[i][0] == label][:positives]:
            fits = [i for i in order if x[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(fits[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed, monkeypatch):
    """Clusters, ties, copies and odd rows; groups and slices of a few rows, so that results meet from many of them."""
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "SLICE", 40)
    r = random.Random(seed)
    rows = made(400, 3, seed)
    if seed == 2:
        rows = [(i, v and [None if c is None else c if not math.isfinite(c) else float(round(c)) for c in v], label) for i, v, label in rows]
    rows += [(i, v, 3 - label) for i, v, label in r.sample([x for x in rows if x[2] is not None], 30)]
    out = negatives.mine_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()
    got = sorted((x.anchor_id, x.positive_id, x.rank, x.negative_id, x.positive_score, x.negative_score) for x in out)
    assert got == mined(rows) and got


def test_rows_go_only_where_they_may_serve(spark):
    """Far clusters of both labels: each row is offered to few of the cells, and none is missed."""
    r = random.Random(3)
    centre = [[40.0 * math.cos(2 * math.pi * k / 40), 40.0 * math.sin(2 * math.pi * k / 40)] for k in range(40)]
    rows = [(i, [c + r.gauss(0, 0.05) for c in centre[i % 40]], i // 40 % 2) for i in range(4000)]
    table = negatives.taking_part(frame(spark, rows))
    chosen = table.filter("vec_id % 3 = 0")
    pivots = negatives.choose_pivots(table, chosen)
    every = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit(-negatives.ANY).alias("low"), F.lit(negatives.ANY).alias("high")))
    cells = negatives.in_cells(chosen.withColumn("bands", every), pivots, 5, True)
    told = sorted(cells.groupBy("cell").agg(F.max("own").alias("radius"), F.max("far").alias("far")).collect())
    q = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v, _ in rows])
    offered = sum(int((pivots.of_rows(q)[:, t.cell] - t.radius <= t.far).sum()) for t in told)
    assert len(told) > 5 and offered < 0.8 * len(rows) * len(told)


def test_hard_negatives_of_odd_tables(spark):
    anchors = F.col("vec_id") % 10 == 0
    for rows in ([], [(1, [1.0], 1)], [(10, None, 1)], [(10, [1.0], 1)], [(10, [1.0], 1), (11, [1.0], 1)], [(10, [-1.0], 1), (11, [1.0], 1), (12, [1.0], 2)]):
        assert negatives.mine_negatives(frame(spark, rows), anchors).count() == 0
    big = 2.0**21
    rows = [(10, [big, 1.0], 1), (11, [big, 2.0], 1), (12, [big * 0.9, 3.0], 2), (13, [big * 0.951, 3.0], 2), (14, [1e30, 1.0], 2)]
    got = [(r.positive_id, r.negative_id, r.positive_score) for r in negatives.mine_negatives(frame(spark, rows), anchors).collect()]
    assert got == [(11, 12, (1 << 58) + 2 * 65536)]
