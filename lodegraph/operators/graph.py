"""Edge weights, propagation of scores over candidates, graded relevance."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EDGE_WEIGHTS, ROLE_MODIFIERS, VISUAL_MODIFIER, VISUAL_TYPES, WEIGHT_MODES
from ..session import cut, ship


def _choose(c: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def edge_weight(
    kind: Column, confidence: Column, role: Column, target: Column, mode: str = "full",
    base: dict[str, float] | None = None,
) -> Column:
    """The weight of an edge towards a node of type ``target`` and section role ``role``.

    Role and visual factors are for ``refer_to`` only; a missing target has neither. Unknown kinds weigh 0, except in
    the uniform mode, where every edge weighs 1.
    """
    if mode not in WEIGHT_MODES:
        raise ValueError(f"no weight mode {mode!r}")
    if mode == "uniform":
        return F.lit(1.0)
    w = _choose(kind, base or EDGE_WEIGHTS, 0.0) * confidence
    if mode in ("base+role", "full"):
        w = w * F.when(kind == "refer_to", _choose(role, ROLE_MODIFIERS, 1.0)).otherwise(1.0)
    if mode in ("base+visual", "full"):
        w = w * F.when((kind == "refer_to") & target.isin(*VISUAL_TYPES), VISUAL_MODIFIER).otherwise(1.0)
    return w


def weighted_edges(edges: DataFrame, nodes: DataFrame, mode: str = "full") -> DataFrame:
    """(doc_id, src, dst, w): both directions where an edge has two, the back one at the greater of its two weights."""
    n = nodes.select("doc_id", "id", F.col("type").alias("kind"), F.col("section_role").alias("role"))
    to, back = (n.select("doc_id", F.col("id").alias(k), F.col("kind").alias(f"{k}_kind"), F.col("role").alias(f"{k}_role")) for k in ("dst", "src"))
    d = edges.join(to, ["doc_id", "dst"], "left").join(back, ["doc_id", "src"], "left")
    forth = edge_weight(F.col("type"), F.col("confidence"), F.col("dst_role"), F.col("dst_kind"), mode)
    home = F.greatest(forth, edge_weight(F.col("type"), F.col("confidence"), F.col("src_role"), F.col("src_kind"), mode))
    row = lambda s, t, w: F.struct(F.col(s).alias("src"), F.col(t).alias("dst"), w.alias("w"))
    ways = F.when(F.col("bidirectional"), F.array(row("src", "dst", forth), row("dst", "src", home))).otherwise(
        F.array(row("src", "dst", forth)))
    return d.select("doc_id", F.explode(ways).alias("e")).select("doc_id", "e.*")


def transition(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, src, dst, p): edges between a query's candidates, the heaviest of each pair, over the sum of their source.

    ``candidates`` is (qid, doc_id, id), ``edges`` (doc_id, src, dst, w). The candidates of a query are a shortlist, and
    the first join keeps edges of documents that have one; a candidate without edges has no row.
    """
    ends = candidates.select("qid", "doc_id", "id")
    d = ends.withColumnRenamed("id", "src").join(edges, ["doc_id", "src"])
    d = d.join(ends.select("qid", "doc_id", F.col("id").alias("dst")), ["qid", "doc_id", "dst"])
    d = d.groupBy("qid", "src", "dst").agg(F.max("w").alias("w"))
    total = d.groupBy("qid", "src").agg(F.sum("w").alias("all"))
    return d.join(total, ["qid", "src"]).select("qid", "src", "dst", (F.col("w") / F.greatest("all", F.lit(1e-9))).alias("p"))


def _step(state: DataFrame, p: DataFrame, own: Column, alpha_in: float, column: str) -> DataFrame:
    moved = p.join(state.select("qid", F.col("id").alias("src"), F.col(column).alias("mass")), ["qid", "src"]).groupBy(
        "qid", F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("mass")).alias("came"))
    d = state.join(moved, ["qid", "id"], "left")
    return d.withColumn(column, own + alpha_in * F.coalesce("came", F.lit(0.0))).drop("came")


def diffuse(candidates: DataFrame, p: DataFrame, alpha: float = 0.3, steps: int = 2) -> DataFrame:
    """``refined``: s <- (1 - alpha) s + alpha Pt s, ``steps`` times. A candidate without edges decays."""
    d = candidates.withColumn("refined", F.col("score"))
    for _ in range(steps):
        d = _step(d, p, (1 - alpha) * F.col("refined"), alpha, "refined")
    return d


def page_rank(candidates: DataFrame, p: DataFrame, alpha: float = 0.3, steps: int = 10) -> DataFrame:
    """``refined``: s <- alpha q + (1 - alpha) Pt s from s = q, ``steps`` times, as joins."""
    d = candidates.withColumn("refined", F.col("score"))
    for i in range(steps):
        if i and i % 2 == 0:  # each step names the last one twice: plans would double with every step
            d = cut(d)
        d = _step(d, p, alpha * F.col("score"), 1 - alpha, "refined")
    return d


def page_rank_until(
    candidates: DataFrame, p: DataFrame, alpha: float = 0.3, max_iter: int = 30, tol: float = 1e-4
) -> DataFrame:
    """``refined`` as in ``page_rank``, stopping a query once no score moves by ``tol``.

    How long a query takes depends on its data, so each query's shortlist and its edges, which are few, are one group
    for numpy.
    """
    ship(candidates.sparkSession)

    def run(s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if s.empty:
            return pd.DataFrame(columns=["qid", "id", "refined"])
        if e.empty:  # without edges there are no columns either
            e = pd.DataFrame({"src": [], "dst": [], "p": []})
        at = {x: i for i, x in enumerate(s["id"])}
        src, dst = (e[k].map(at).to_numpy(float).astype(int) for k in ("src", "dst"))
        q = s["score"].to_numpy(float)
        now = q.copy()
        for _ in range(max_iter):
            new = alpha * q + (1 - alpha) * np.bincount(dst, e["p"].to_numpy(float) * now[src], len(q))
            moved, now = np.abs(new - now).max(initial=0.0), new
            if moved < tol:
                break
        return pd.DataFrame({"qid": s["qid"], "id": s["id"], "refined": now})

    d = candidates.select("qid", "id", "score")
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    out = d.groupBy("qid").cogroup(p.select(F.col("qid").alias("of"), "src", "dst", "p").groupBy("of")).applyInPandas(
        run, f"qid {kinds['qid']}, id {kinds['id']}, refined double")
    return candidates.join(out, ["qid", "id"])


def propagate(candidates: DataFrame, p: DataFrame | None, method: str, **options) -> DataFrame:
    """``refined`` by method: none, diffusion, ppr."""
    if method == "none":
        return candidates.withColumn("refined", F.col("score"))
    if method == "diffusion":
        return diffuse(candidates, p, **options)
    if method == "ppr":
        return page_rank_until(candidates, p, **options)
    raise ValueError(f"no propagation method {method!r}")


def relevance(anchors: DataFrame, edges: DataFrame, gamma: float = 0.5, max_hops: int = 2) -> DataFrame:
    """(doc_id, anchor, id, relevance): the heaviest product of weights on a path of at most ``max_hops`` edges.

    Each edge after the first costs a factor ``gamma``; the anchor has relevance 1 and no path returns to it. ``edges``
    is (doc_id, src, dst, w) with both directions in it. Every hop keeps the best path to each node only.
    """
    one = anchors.select("doc_id", F.col("id").alias("anchor"))
    layer = one.select("doc_id", "anchor", F.col("anchor").alias("id"), F.lit(1.0).alias("relevance"))
    found = layer
    for hop in range(max_hops):
        d = layer.withColumnRenamed("id", "src").join(edges, ["doc_id", "src"]).filter("dst <> anchor AND w > 0")
        cost = F.col("relevance") * F.col("w") * (gamma if hop else 1.0)
        layer = d.groupBy("doc_id", "anchor", F.col("dst").alias("id")).agg(F.max(cost).alias("relevance"))
        found = found.union(layer.select("doc_id", "anchor", "id", "relevance"))
    return found.groupBy("doc_id", "anchor", "id").agg(F.max("relevance").alias("relevance"))


# Named ways to propagate, (name, method, weight mode, alpha, steps); steps are at most those of a PageRank.
VARIANTS = (
    ("no_prop", "none", "full", 0.0, 0),
    ("uniform_a01_T2", "diffusion", "uniform", 0.1, 2),
    ("uniform_a03_T1", "diffusion", "uniform", 0.3, 1),
    ("uniform_a03_T2", "diffusion", "uniform", 0.3, 2),
    ("uniform_a03_T3", "diffusion", "uniform", 0.3, 3),
    ("uniform_a05_T2", "diffusion", "uniform", 0.5, 2),
    ("wbase_a03_T2", "diffusion", "base", 0.3, 2),
    ("wbase_role_a03_T2", "diffusion", "base+role", 0.3, 2),
    ("wbase_vis_a03_T2", "diffusion", "base+visual", 0.3, 2),
    ("wfull_a03_T2", "diffusion", "full", 0.3, 2),
    ("wfull_a01_T2", "diffusion", "full", 0.1, 2),
    ("wfull_a05_T2", "diffusion", "full", 0.5, 2),
    ("wfull_a07_T2", "diffusion", "full", 0.7, 2),
    ("wfull_a03_T1", "diffusion", "full", 0.3, 1),
    ("wfull_a03_T3", "diffusion", "full", 0.3, 3),
    ("ppr_a015", "ppr", "full", 0.15, 30),
    ("ppr_a030", "ppr", "full", 0.3, 30),
    ("ppr_a050", "ppr", "full", 0.5, 30),
    ("ppr_a070", "ppr", "full", 0.7, 30),
    ("ppr_a085", "ppr", "full", 0.85, 30),
    ("ppr_unif_a030", "ppr", "uniform", 0.3, 30),
    ("ppr_unif_a050", "ppr", "uniform", 0.5, 30),
    ("prop_a03_T2", "diffusion", "full", 0.3, 2),
    ("prop_a01_T2", "diffusion", "full", 0.1, 2),
    ("prop_a05_T2", "diffusion", "full", 0.5, 2),
    ("prop_a07_T2", "diffusion", "full", 0.7, 2),
    ("prop_a03_T1", "diffusion", "full", 0.3, 1),
    ("prop_a03_T3", "diffusion", "full", 0.3, 3),
)


def sweep(candidates: DataFrame, p: DataFrame, variants: tuple = VARIANTS, tol: float = 1e-4) -> DataFrame:
    """(qid, id, rank, variant, refined) of a shortlist under all variants at once.

    ``p`` is (qid, mode, src, dst, p), the transitions of each weight mode. A query's shortlist and edges are one small
    group, in which all variants are runs of the same matrices; what the variants share is not computed anew.
    """
    ship(candidates.sparkSession)

    def run(s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if s.empty:
            return pd.DataFrame(columns=["qid", "id", "rank", "variant", "refined"])
        at, q, moved = {x: i for i, x in enumerate(s["id"])}, s["score"].to_numpy(float), {}
        for mode, g in e.groupby("mode") if not e.empty else ():
            m = np.zeros((len(q), len(q)))
            m[g["dst"].map(at).to_numpy(int), g["src"].map(at).to_numpy(int)] = g["p"].to_numpy(float)
            moved[mode] = m
        out = []
        for name, method, mode, alpha, steps in variants:
            m, now = moved.get(mode, np.zeros((len(q), len(q)))), q
            for _ in range(steps):
                new = alpha * q + (1 - alpha) * (m @ now) if method == "ppr" else (1 - alpha) * now + alpha * (m @ now)
                stop, now = method == "ppr" and np.abs(new - now).max(initial=0.0) < tol, new
                if stop:
                    break
            out.append(s[["qid", "id", "rank"]].assign(variant=name, refined=now))
        return pd.concat(out)

    d = candidates.select("qid", "id", "rank", "score")
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    grouped = d.groupBy("qid").cogroup(p.select(F.col("qid").alias("of"), "mode", "src", "dst", "p").groupBy("of"))
    return grouped.applyInPandas(run, f"qid {kinds['qid']}, id {kinds['id']}, rank {kinds['rank']}, variant string, refined double")


def hop_distances(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("figure", "table", "section_header", "caption")) -> DataFrame:
    """(doc_id, id, and a column for each kind): hops to the nearest node of that kind, 0 for a node of the kind itself, null where
    none can be reached.

    ``nodes`` is (doc_id, id, type), ``edges`` (doc_id, src, dst), walked both ways; edges whose ends are not both nodes of their
    document lead nowhere. All nodes of a kind are sources at once. The frontier are the nodes that some kind reached in
    the last round; its neighbours get the next number where they have none yet, and the search ends with the first round that
    moves nothing. Each round's state is kept in the shared folder.
    """
    ends = [edges.select("doc_id", F.col(a).alias("from"), F.col(b).alias("id")) for a, b in (("src", "dst"), ("dst", "src"))]
    ways = cut(ends[0].union(ends[1]).filter("from <> id").distinct())
    state = cut(nodes.select("doc_id", "id", *[F.when(F.col("type") == k, 0).alias(k) for k in kinds]))
    step = 0
    while True:
        last = state.filter(reduce(lambda a, b: a | b, [F.col(k) == step for k in kinds]))
        told = last.select("doc_id", F.col("id").alias("from"), *[F.when(F.col(k) == step, step + 1).alias(f"next_{k}") for k in kinds])
        told = told.join(ways, ["doc_id", "from"]).groupBy("doc_id", "id").agg(*[F.min(f"next_{k}").alias(f"next_{k}") for k in kinds])
        state = cut(state.join(told, ["doc_id", "id"], "left").select("doc_id", "id", *[F.coalesce(k, f"next_{k}").alias(k) for k in kinds]))
        step += 1
        if not state.filter(reduce(lambda a, b: a | b, [F.col(k) == step for k in kinds])).take(1):
            return state
