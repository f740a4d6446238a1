"""Retrieval over token vectors: scores, fusion, propagation, relevance, losses, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import graph, losses, metrics, ranking, stats
from ..schema import WEIGHT_MODES
from ..session import cut
from .base import query, source

DOT = "list_dot_product(q::DOUBLE[], v::DOUBLE[])"
#: Candidates of each query in its own document, with scores that both engines round alike.
SCORED = f"""scored AS (SELECT qid, ask.doc_id, vec.id, vec.id AS ord, label, q_label, modality, vec.type, vec.section_role,
    round({DOT}, 6) AS score FROM ask JOIN vec ON ask.doc_id = vec.doc_id WHERE qid <> vec.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM scored)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, doc_id, id, ord, label, q_label, modality, type, section_role, score) of candidates in the query's document."""
    d = source(spark, sf_dir, "ask").join(source(spark, sf_dir, "vec"), "doc_id").filter("qid <> id")
    return d.select("qid", "doc_id", "id", F.col("id").alias("ord"), "label", "q_label", "modality", "type", "section_role",
                    F.round(V.dot(F.col("q"), F.col("v")), 6).alias("score"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(scored(spark, sf_dir), ["qid"])


@query(f"WITH {SCORED} SELECT qid, id, rank, score FROM ranked WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    return ranking.top(scored(spark, sf_dir), ["qid"], 10).select("qid", "id", "rank", "score")


@query(f"""WITH s AS (SELECT qid, vec.id, round({DOT}, 6) AS score FROM ask, vec WHERE qid <> vec.id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
SELECT qid, id, rank, score FROM r WHERE rank <= 20""")
def cosine_topk_global(spark, sf_dir):
    """A stated set of queries against all vectors."""
    return ranking.nearest(source(spark, sf_dir, "ask").select("qid", "q"), source(spark, sf_dir, "vec").select("id", "v"), 20)


def _tokens(c: str):
    return V.token_matrix(F.col(c), 4, 16)


def _max_sim(spark, sf_dir, masked: bool):
    d = source(spark, sf_dir, "ask").join(source(spark, sf_dir, "vec"), "doc_id").filter("qid <> id")
    d = d.withColumns({"qt": _tokens("q"), "et": _tokens("v")})
    ok = {}
    if masked:
        ok = {"q_valid": F.array(*[(F.col("qid") + i) % 3 != 0 for i in range(4)]),
              "e_valid": F.array(*[(F.col("id") + i) % 4 != 0 for i in range(4)])}
    d = d.withColumn("score", F.round(V.max_sim(F.col("qt"), F.col("et"), **ok), 6)).withColumn("ord", F.col("id"))
    return ranking.top(d, ["qid"], 10).select("qid", "id", "rank", "score")


def _max_sim_sql(masked: bool) -> str:
    q_ok, e_ok = ("(a.qid + a.i) % 3 <> 0", "(b.id + b.j) % 4 <> 0") if masked else ("true", "true")
    return f"""WITH i AS (SELECT unnest(range(4)) AS i),
a AS (SELECT qid, doc_id, i, q[1 + 16 * i:16 + 16 * i]::DOUBLE[] AS t FROM ask, i),
b AS (SELECT id, doc_id, i AS j, v[1 + 16 * i:16 + 16 * i]::DOUBLE[] AS t FROM vec, i),
m AS (SELECT qid, id, a.i, CASE WHEN {q_ok} THEN max(CASE WHEN {e_ok} THEN list_cosine_similarity(a.t, b.t) ELSE -10000.0 END) ELSE 0.0 END AS m
      FROM a JOIN b ON a.doc_id = b.doc_id AND qid <> id GROUP BY qid, id, a.i),
s AS (SELECT qid, id, round(sum(m), 6) AS score FROM m GROUP BY qid, id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
SELECT qid, id, rank, score FROM r WHERE rank <= 10"""


@query(_max_sim_sql(False))
def maxsim_topk(spark, sf_dir):
    return _max_sim(spark, sf_dir, False)


@query(_max_sim_sql(True))
def maxsim_masked(spark, sf_dir):
    return _max_sim(spark, sf_dir, True)


@query(f"""WITH {SCORED}, f AS (SELECT qid, id, round(1 / (60.0 + row_number() OVER (PARTITION BY qid, modality ORDER BY score DESC, ord)), 6) AS rrf FROM scored)
SELECT * FROM f""")
def rrf_fusion(spark, sf_dir):
    return ranking.reciprocal_rank(scored(spark, sf_dir), ["qid"]).select("qid", "id", F.round("rrf", 6).alias("rrf"))


@query(f"""WITH {SCORED} SELECT qid, id, round((score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-8), 4) AS z FROM scored
WINDOW w AS (PARTITION BY qid, modality)""")
def zscore_fusion(spark, sf_dir):
    return ranking.z_score(scored(spark, sf_dir), ["qid"]).select("qid", "id", F.round("z", 4).alias("z"))


def _weight_sql(mode: str, node: str) -> str:
    if mode == "uniform":
        return "1.0::DOUBLE"
    w = "(CASE e.type WHEN 'caption_of' THEN 1.0 WHEN 'refer_to' THEN 0.8 WHEN 'contains' THEN 0.5 WHEN 'reading_next' THEN 0.3 WHEN 'section_next' THEN 0.2 ELSE 0 END)::DOUBLE * e.confidence::DOUBLE"
    if mode in ("base+role", "full"):
        w += f" * CASE WHEN e.type = 'refer_to' THEN (CASE {node}.section_role WHEN 'appendix' THEN 1.3 WHEN 'front_matter' THEN 0.8 WHEN 'references' THEN 0.5 ELSE 1 END)::DOUBLE ELSE 1 END"
    if mode in ("base+visual", "full"):
        w += f" * CASE WHEN e.type = 'refer_to' AND {node}.type IN ('figure', 'table', 'equation') THEN 1.1::DOUBLE ELSE 1 END"
    return w


def _edges_sql(mode: str, name: str = "w") -> str:
    forth, back = _weight_sql(mode, "d"), _weight_sql(mode, "s")
    return f"""{name}0 AS (SELECT e.doc_id, e.src, e.dst, e.bidirectional AS both_ways, {forth} AS f, {back} AS b
    FROM edge e LEFT JOIN vec d ON e.dst = d.id AND e.doc_id = d.doc_id LEFT JOIN vec s ON e.src = s.id AND e.doc_id = s.doc_id),
{name} AS (SELECT doc_id, src, dst, f AS w FROM {name}0 UNION ALL SELECT doc_id, dst, src, greatest(f, b) FROM {name}0 WHERE both_ways)"""


def edges(spark, sf_dir, mode: str = "full") -> DataFrame:
    return graph.weighted_edges(source(spark, sf_dir, "edge"), source(spark, sf_dir, "vec"), mode)


@query("WITH " + ", ".join(_edges_sql(m, f"w{i}x") for i, m in enumerate(WEIGHT_MODES)) + " " + " UNION ALL ".join(
    f"SELECT '{m}' AS mode, src, dst, round(w, 6) AS w FROM w{i}x" for i, m in enumerate(WEIGHT_MODES)))
def edge_effective_weight(spark, sf_dir):
    return metrics.union_all([edges(spark, sf_dir, m).select(F.lit(m).alias("mode"), "src", "dst", F.round("w", 6).alias("w")) for m in WEIGHT_MODES])


TOP = "short AS (SELECT * FROM ranked WHERE rank <= 50)"


def _p_sql(mode: str) -> str:
    return f"""{SCORED}, {TOP}, {_edges_sql(mode)},
pm AS (SELECT a.qid, a.id AS src, b.id AS dst, max(w.w) AS w FROM w JOIN short a ON w.src = a.id AND w.doc_id = a.doc_id
    JOIN short b ON w.dst = b.id AND a.qid = b.qid GROUP BY a.qid, a.id, b.id),
p AS (SELECT qid, src, dst, w / greatest(sum(w) OVER (PARTITION BY qid, src), 1e-9) AS p FROM pm)"""


def _steps_sql(steps: int, own: str, came: float) -> str:
    out = "z0 AS MATERIALIZED (SELECT qid, id, score, score::DOUBLE AS x FROM short)"
    for i in range(steps):
        out += f""", z{i + 1} AS MATERIALIZED (SELECT z.qid, z.id, z.score, {own} + {came} * coalesce(m.m, 0) AS x FROM z{i} z LEFT JOIN
    (SELECT p.qid, p.dst, sum(p.p * y.x) AS m FROM p JOIN z{i} y ON p.qid = y.qid AND p.src = y.id GROUP BY p.qid, p.dst) m ON z.qid = m.qid AND z.id = m.dst)"""
    return out


def shortlist(spark, sf_dir) -> DataFrame:
    return ranking.top(scored(spark, sf_dir), ["qid"])


def matrix(spark, sf_dir, short: DataFrame, mode: str = "full") -> DataFrame:
    return graph.transition(short, edges(spark, sf_dir, mode))


def _register_matrix(mode: str) -> None:
    name = mode.replace("+", "_")

    @query(f"WITH {_p_sql(mode)} SELECT qid, src, dst, round(p, 6) AS p FROM p", name=f"transition_matrix_{name}")
    def f(spark, sf_dir):
        return matrix(spark, sf_dir, shortlist(spark, sf_dir), mode).select("qid", "src", "dst", F.round("p", 6).alias("p"))


def _told(name: str, digits: int):
    """``name`` rounded as a binary number, as the SQL engine does; Spark's ``round`` goes by the shortest decimal, so
    that the two part at ties such as 0.0332896715625."""
    return (F.round(F.col(name) * F.lit(10.0**digits)) / F.lit(10.0**digits)).alias(name)


def _register_diffusion(mode: str, alpha: float, steps: int) -> None:
    name = f"diffusion_{mode.replace('+', '_')}_a{int(alpha * 100):02d}_T{steps}"

    @query(f"WITH {_p_sql(mode)}, {_steps_sql(steps, f'{1 - alpha} * z.x', alpha)} SELECT qid, id, round(x, 12) AS refined FROM z{steps}", name=name)
    def f(spark, sf_dir):
        short = shortlist(spark, sf_dir)
        return graph.diffuse(short, matrix(spark, sf_dir, short, mode), alpha, steps).select("qid", "id", _told("refined", 12))


for _m in WEIGHT_MODES:
    _register_matrix(_m)
    _register_diffusion(_m, 0.3, 2)
for _a, _t in ((0.0, 2), (0.3, 1), (0.3, 3), (0.5, 2), (0.7, 2)):
    _register_diffusion("full", _a, _t)


@query(f"WITH {_p_sql('full')}, {_steps_sql(6, '0.3 * z.score', 0.7)} SELECT qid, id, round(x, 6) AS refined FROM z6")
def ppr_fixed6(spark, sf_dir):
    short = shortlist(spark, sf_dir)
    return graph.page_rank(short, matrix(spark, sf_dir, short), 0.3, 6).select("qid", "id", _told("refined", 6))


def _until_sql(alpha: float, most: int, tol: float) -> str:
    """Steps of a PageRank in which each query keeps its scores from when none moved by ``tol``."""
    out = "z0 AS MATERIALIZED (SELECT qid, id, score, score::DOUBLE AS x, false AS done FROM short)"
    for i in range(most):
        out += f""", z{i + 1} AS MATERIALIZED (SELECT qid, id, score, CASE WHEN done THEN x ELSE n END AS x, done OR max(abs(n - x)) OVER (PARTITION BY qid) < {tol} AS done
    FROM (SELECT z.*, {alpha} * z.score + {1 - alpha} * coalesce(m.m, 0) AS n FROM z{i} z LEFT JOIN (SELECT p.qid, p.dst, sum(p.p * y.x) AS m
    FROM p JOIN z{i} y ON p.qid = y.qid AND p.src = y.id GROUP BY p.qid, p.dst) m ON z.qid = m.qid AND z.id = m.dst))"""
    return out


@query(f"WITH {_p_sql('full')}, {_until_sql(0.3, 30, 1e-4)} SELECT qid, id, round(x, 8) AS refined FROM z30")
def ppr_until(spark, sf_dir):
    """Each query stops on its own, once no score moves by 1e-4; eight digits show the step at which it stopped."""
    short = shortlist(spark, sf_dir)
    d = graph.page_rank_until(short, matrix(spark, sf_dir, short), 0.3, max_iter=30)
    return d.select("qid", "id", _told("refined", 8))


MERGED = f"""{_p_sql('full')}, {_steps_sql(2, '0.7 * z.x', 0.3)}, final AS (SELECT r.qid, r.id, row_number() OVER (PARTITION BY r.qid
    ORDER BY z2.x IS NULL, round(z2.x, 6) DESC, r.rank) AS final_rank FROM ranked r LEFT JOIN z2 ON r.qid = z2.qid AND r.id = z2.id)"""


def reranked(spark, sf_dir) -> DataFrame:
    base = ranked(spark, sf_dir)
    short = base.filter("rank <= 50")
    refined = graph.diffuse(short, matrix(spark, sf_dir, short)).withColumn("refined", F.round("refined", 6))
    return ranking.merge_tail(base, refined, ["qid"])


@query(f"WITH {MERGED} SELECT qid, id, final_rank FROM final")
def rerank_merge(spark, sf_dir):
    return reranked(spark, sf_dir).select("qid", "id", "final_rank")


TRUTH = "gt AS (SELECT qid, id FROM scored WHERE label = q_label)"


def _metrics_sql(rank: str, frm: str, extra: str = "") -> str:
    cols = ", ".join(
        f"round(avg(coalesce(n{k}, 0) / greatest(n_gt, 1)), 6) AS recall{k}, round(avg((coalesce(n{k}, 0) > 0)::INT), 6) AS hit{k}, "
        f"round(avg((coalesce(n{k}, 0) = n_gt)::INT), 6) AS perfect{k}" for k in (1, 5, 10))
    return f"""h AS (SELECT g.qid, count(*) AS n_gt, min(f.{rank}) AS first, {", ".join(f"count(*) FILTER (f.{rank} <= {k}) AS n{k}" for k in (1, 5, 10))}
    FROM gt g JOIN {frm} f ON g.qid = f.qid AND g.id = f.id GROUP BY g.qid),
a AS (SELECT ask.qid, ask.q_label, coalesce(n_gt, 0) AS n_gt, first, n1, n5, n10 FROM ask LEFT JOIN h ON ask.qid = h.qid)
SELECT {extra}round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, {cols}, count(*) AS n_queries FROM a"""


NAMES = ["mrr", *[f"{m}{k}" for k in (1, 5, 10) for m in ("recall", "hit", "perfect")]]


def truth(spark, sf_dir) -> DataFrame:
    d = scored(spark, sf_dir).groupBy("qid", "q_label").agg(F.collect_set(F.when(F.col("label") == F.col("q_label"), F.col("id"))).alias("gt"))
    return d


def _rounded(d: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    return d.select(*by, *[F.round(n, 6).alias(n) for n in names], "n_queries")


@query(f"WITH {SCORED}, {TRUTH}, {_metrics_sql('rank', 'ranked')}")
def retrieval_metrics(spark, sf_dir):
    d = metrics.retrieval(ranked(spark, sf_dir), truth(spark, sf_dir))
    return _rounded(metrics.averages(d, NAMES), NAMES, [])


@query(f"WITH {MERGED}, {TRUTH}, {_metrics_sql('final_rank', 'final')}")
def retrieval_metrics_propagated(spark, sf_dir):
    d = metrics.retrieval(reranked(spark, sf_dir).drop("rank").withColumnRenamed("final_rank", "rank"), truth(spark, sf_dir))
    return _rounded(metrics.averages(d, NAMES), NAMES, [])


_bucket = "CASE WHEN GROUPING(q_label % 2) = 1 THEN 'all' WHEN q_label % 2 = 0 THEN 'text' ELSE 'visual' END AS bucket, "


@query(f"WITH {SCORED}, {TRUTH}, {_metrics_sql('rank', 'ranked', _bucket)} GROUP BY GROUPING SETS ((q_label % 2), ())")
def retrieval_metrics_by_bucket(spark, sf_dir):
    d = metrics.retrieval(ranked(spark, sf_dir), truth(spark, sf_dir)).join(source(spark, sf_dir, "ask").select("qid", "q_label"), "qid")
    d = d.withColumn("bucket", F.when(F.col("q_label") % 2 == 0, "text").otherwise("visual"))
    return _rounded(metrics.bucketed(d, NAMES), NAMES, ["bucket"])


@query(f"""WITH {SCORED}, i AS (SELECT *, (label = q_label)::INT + (label % 2 = q_label % 2)::INT AS rel FROM ranked),
j AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, rank) AS best FROM i)
SELECT qid, round(CASE WHEN sum(CASE WHEN best <= 10 THEN (2 ** rel - 1) / log2(best + 1) ELSE 0 END) > 0
  THEN sum(CASE WHEN rank <= 10 THEN (2 ** rel - 1) / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN best <= 10 THEN (2 ** rel - 1) / log2(best + 1) ELSE 0 END)
  ELSE 0 END, 6) AS ndcg FROM j GROUP BY qid""")
def ndcg_at_k(spark, sf_dir):
    rel = (F.col("label") == F.col("q_label")).cast("int") + (F.col("label") % 2 == F.col("q_label") % 2).cast("int")
    return metrics.ndcg(ranked(spark, sf_dir).withColumn("rel", rel), ["qid"], 10).withColumn("ndcg", F.round("ndcg", 6))


@query(f"""WITH {SCORED}, f AS (SELECT qid, modality, min(rank) AS first FROM ranked WHERE label % 3 = q_label % 3 GROUP BY qid, modality)
SELECT modality, round(avg(first), 6) AS mean_rank, count(*) AS n_queries FROM f GROUP BY modality""")
def rank_by_modality(spark, sf_dir):
    d = ranked(spark, sf_dir).filter("label % 3 = q_label % 3").groupBy("qid", "modality").agg(F.min("rank").alias("first"))
    return d.groupBy("modality").agg(F.round(F.avg("first"), 6).alias("mean_rank"), F.count("*").alias("n_queries"))


@query(f"""WITH {SCORED}, c AS (SELECT qid, count(*) FILTER (modality = 'text') / 10.0 AS t FROM ranked WHERE rank <= 10 GROUP BY qid)
SELECT round(avg(t), 6) AS text_share, round(avg(1 - t), 6) AS visual_share FROM c""")
def topk_composition(spark, sf_dir):
    d = ranking.top(scored(spark, sf_dir), ["qid"], 10).groupBy("qid").agg((F.count_if(F.col("modality") == "text") / 10.0).alias("t"))
    return d.agg(F.round(F.avg("t"), 6).alias("text_share"), F.round(F.avg(1 - F.col("t")), 6).alias("visual_share"))


@query(f"""WITH {SCORED}, v AS (SELECT *, row_number() OVER (PARTITION BY qid, modality ORDER BY score DESC, ord) AS own,
   count(*) OVER (PARTITION BY qid) AS n FROM ranked),
b AS (SELECT qid, min(rank) AS full_rank, min(own) AS visual_rank, max(n) AS n FROM v WHERE modality = 'visual' AND label = q_label GROUP BY qid)
SELECT count(*) AS n_queries, round(quantile_cont(full_rank, 0.5), 6) AS full_median, round(quantile_cont(visual_rank, 0.5), 6) AS visual_median,
 round(avg((full_rank <= 0.01 * n)::INT), 6) AS in_top_percent FROM b""")
def full_rank_diag(spark, sf_dir):
    d = ranking.rank(ranked(spark, sf_dir), ["qid", "modality"], out="own")
    size = F.count("*").over(ranking.Window.partitionBy("qid"))
    d = d.withColumn("n", size).filter("modality = 'visual' AND label = q_label")
    d = d.groupBy("qid").agg(F.min("rank").alias("full_rank"), F.min("own").alias("visual_rank"), F.max("n").alias("n"))
    return d.agg(F.count("*").alias("n_queries"), F.round(F.percentile("full_rank", F.lit(0.5)), 6).alias("full_median"),
                 F.round(F.percentile("visual_rank", F.lit(0.5)), 6).alias("visual_median"),
                 F.round(F.avg((F.col("full_rank") <= 0.01 * F.col("n")).cast("int")), 6).alias("in_top_percent"))


def _relevance_sql(edge_types: str = "") -> str:
    return f"""{_edges_sql('full', 'w')},
h1 AS (SELECT a.doc_id, a.qid AS anchor, w.dst AS id, max(w.w) AS r FROM ask a JOIN w ON a.qid = w.src AND a.doc_id = w.doc_id AND w.dst <> a.qid AND w.w > 0 GROUP BY a.doc_id, a.qid, w.dst),
h2 AS (SELECT h.doc_id, h.anchor, w.dst AS id, max(h.r * w.w * 0.5) AS r FROM h1 h JOIN w ON h.id = w.src AND h.doc_id = w.doc_id AND w.dst <> h.anchor AND w.w > 0 GROUP BY h.doc_id, h.anchor, w.dst),
u AS (SELECT doc_id, qid AS anchor, qid AS id, 1.0::DOUBLE AS r FROM ask UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)
SELECT anchor, id, round(max(r), 6) AS relevance FROM u GROUP BY anchor, id"""


def _relevance(spark, sf_dir, w: DataFrame) -> DataFrame:
    anchors = source(spark, sf_dir, "ask").select("doc_id", F.col("qid").alias("id"))
    return graph.relevance(anchors, w).select("anchor", "id", F.round("relevance", 6).alias("relevance"))


@query(f"WITH {_relevance_sql()}")
def graph_relevance(spark, sf_dir):
    return _relevance(spark, sf_dir, edges(spark, sf_dir))


@query("WITH " + _relevance_sql().replace("FROM edge e ", "FROM (SELECT * FROM edge WHERE type = 'caption_of') e "))
def graph_relevance_single_edge(spark, sf_dir):
    e = source(spark, sf_dir, "edge").filter("type = 'caption_of'")
    return _relevance(spark, sf_dir, graph.weighted_edges(e, source(spark, sf_dir, "vec")))


_LP = "lp AS (SELECT *, s - max(s) OVER w - ln(sum(exp(s - mx)) OVER w) AS lp FROM (SELECT *, max(s) OVER (PARTITION BY anchor) AS mx FROM {t}) WINDOW w AS (PARTITION BY anchor))"


@query(f"WITH {_LP.format(t='graded')}, x AS (SELECT anchor, sum(rel) AS a, sum(rel * lp) AS d FROM lp GROUP BY anchor) SELECT anchor, round(-d / a, 6) AS loss FROM x WHERE a > 0")
def grcl_loss(spark, sf_dir):
    return losses.grcl(source(spark, sf_dir, "graded")).withColumn("loss", F.round("loss", 6))


@query(f"WITH g AS (SELECT anchor, id, s, CASE WHEN rel >= 0.5 THEN 1.0 ELSE 0.0 END AS rel FROM graded), {_LP.format(t='g')}, x AS (SELECT anchor, sum(rel) AS a, sum(rel * lp) AS d FROM lp GROUP BY anchor) SELECT anchor, round(-d / a, 6) AS loss FROM x WHERE a > 0")
def infonce_loss(spark, sf_dir):
    return losses.info_nce(source(spark, sf_dir, "graded")).withColumn("loss", F.round("loss", 6))


@query("""WITH n AS (SELECT anchor, s, row_number() OVER (PARTITION BY anchor ORDER BY s DESC) AS r FROM graded WHERE rel < 0.1),
x AS (SELECT g.anchor, 10.0 * (n.s - g.s) AS x FROM graded g JOIN n ON g.anchor = n.anchor AND n.r = 3 WHERE g.rel >= 0.5)
SELECT anchor, round(avg(greatest(x, 0) + ln(1 + exp(-abs(x)))), 6) AS loss FROM x GROUP BY anchor""")
def coverage_loss(spark, sf_dir):
    return losses.coverage(source(spark, sf_dir, "graded"), k=3).withColumn("loss", F.round("loss", 6))


@query("""WITH a AS (SELECT anchor, s - ln(sum(exp(s)) OVER w) AS lp, dropped - ln(sum(exp(dropped)) OVER w) AS lq FROM graded WINDOW w AS (PARTITION BY anchor))
SELECT anchor, round(sum(exp(lp) * (lp - lq)), 6) AS loss FROM a GROUP BY anchor""")
def consistency_kl(spark, sf_dir):
    return losses.consistency(source(spark, sf_dir, "graded")).withColumn("loss", F.round("loss", 6))


@query("""WITH c AS (SELECT label, i, avg(v[i]::DOUBLE) AS x FROM vec, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i),
n AS (SELECT label, list(x ORDER BY i) AS m FROM c GROUP BY label)
SELECT vec.id, round(list_cosine_similarity(v::DOUBLE[], m), 6) AS cosine FROM vec JOIN n ON vec.label = n.label""")
def centroid_angles(spark, sf_dir):
    """The centroid of a label is a vector of fixed length; sums of its places are combined before the shuffle."""
    d = source(spark, sf_dir, "vec")
    mean = d.groupBy("label").agg(F.array(*[F.avg(F.col("v")[i].cast("double")) for i in range(64)]).alias("m"))
    return d.join(mean, "label").select("id", F.round(V.cosine(F.col("v"), F.col("m")), 6).alias("cosine"))


@query("""WITH m AS (SELECT modality, i, sum(v[i]::DOUBLE) AS s, count(*) AS n FROM vec, (SELECT unnest(range(1, 65)) AS i) GROUP BY modality, i)
SELECT round(sum(t.s * x.s) / max(t.n * x.n), 6) AS across, round(sum(t.s * t.s) / max(t.n * t.n), 6) AS text, round(sum(x.s * x.s) / max(x.n * x.n), 6) AS visual
FROM m t JOIN m x ON t.i = x.i AND t.modality = 'text' AND x.modality = 'visual'""")
def modality_gap(spark, sf_dir):
    """Mean cosine of all pairs across and within modalities. The mean of inner products is that of the sums: no pairs."""
    d = source(spark, sf_dir, "vec")
    place = [F.sum(F.when(F.col("modality") == m, F.col("v")[i].cast("double")).otherwise(0.0)) for m in ("text", "visual") for i in range(64)]
    n = [F.count_if(F.col("modality") == "text").alias("nt"), F.count_if(F.col("modality") == "visual").alias("nv")]
    d = d.agg(F.array(*place[:64]).alias("t"), F.array(*place[64:]).alias("x"), *n)
    mean = lambda a, b, k: F.round(V.dot(F.col(a), F.col(b)) / k, 6)
    return d.select(mean("t", "x", F.col("nt") * F.col("nv")).alias("across"), mean("t", "t", F.col("nt") * F.col("nt")).alias("text"),
                    mean("x", "x", F.col("nv") * F.col("nv")).alias("visual"))


_SEVEN = "round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.75), 6) AS p75, round(min(x), 6) AS low, round(max(x), 6) AS high"
_PAIR = "WITH c AS (SELECT a.type, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS x FROM edge e JOIN vec a ON e.src = a.id JOIN vec b ON e.dst = b.id WHERE e.type = 'caption_of')"


def _pair_cosines(spark, sf_dir) -> DataFrame:
    n = source(spark, sf_dir, "vec")
    e = source(spark, sf_dir, "edge").filter("type = 'caption_of'").select("src", "dst")
    e = e.join(n.select(F.col("id").alias("src"), "type", F.col("v").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst")
    return e.select("type", V.cosine(F.col("a"), F.col("b")).alias("x"))


@query(f"{_PAIR} SELECT {_SEVEN} FROM c")
def seven_number_summary(spark, sf_dir):
    d = _pair_cosines(spark, sf_dir).agg(*stats.seven_numbers())
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


@query(f"{_PAIR} SELECT type, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM c GROUP BY type")
def type_breakdown(spark, sf_dir):
    return _pair_cosines(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


@query("SELECT id, round(sin(id / 100.0), 6) AS s0, round(cos(id / 100.0), 6) AS c0, round(sin(id / 100.0 * exp(-ln(1000.0) / 4)), 6) AS s1 FROM vec")
def sinusoidal_places(spark, sf_dir):
    code = V.sinusoid(F.col("id") / 100.0, 8)
    return source(spark, sf_dir, "vec").select("id", code.alias("c")).select("id", F.round(F.get("c", F.lit(0)), 6).alias("s0"), F.round(F.get("c", F.lit(4)), 6).alias("c0"), F.round(F.get("c", F.lit(1)), 6).alias("s1"))


@query("""WITH f AS (SELECT id, v[1:16]::DOUBLE[] AS a, v[17:32]::DOUBLE[] AS b FROM vec)
SELECT id, round(list_cosine_similarity(a, [z[1] + z[2] for z in list_zip(a, b)]), 6) AS cosine FROM f""")
def fused_cosine(spark, sf_dir):
    d = source(spark, sf_dir, "vec").select("id", F.slice("v", 1, 16).alias("a"), F.slice("v", 17, 16).alias("b"))
    return d.select("id", F.round(V.cosine(F.col("a"), V.fuse(F.col("a"), F.col("b"))), 6).alias("cosine"))


def _sweep_sql() -> str:
    modes = {m: f"m{i}" for i, m in enumerate(WEIGHT_MODES)}
    out = f"WITH {SCORED}, {TOP}, {TRUTH}"
    for mode, k in modes.items():
        out += f""", {_edges_sql(mode, k + 'w')},
{k}p AS (SELECT a.qid, a.id AS src, b.id AS dst, max(w.w) AS w FROM {k}w w JOIN short a ON w.src = a.id AND w.doc_id = a.doc_id
    JOIN short b ON w.dst = b.id AND a.qid = b.qid GROUP BY a.qid, a.id, b.id),
{k}t AS MATERIALIZED (SELECT qid, src, dst, w / greatest(sum(w) OVER (PARTITION BY qid, src), 1e-9) AS p FROM {k}p)"""
    parts = []
    for name, method, mode, alpha, steps in graph.VARIANTS:
        own = f"{alpha} * z.score" if method == "ppr" else f"{1 - alpha} * z.x"
        came = 1 - alpha if method == "ppr" else alpha
        out += f", {name}_0 AS MATERIALIZED (SELECT qid, id, rank, score, score::DOUBLE AS x, false AS done FROM short)"
        for i in range(steps):
            now = "done OR max(abs(n - x)) OVER (PARTITION BY qid) < 1e-4" if method == "ppr" else "false"
            out += f""", {name}_{i + 1} AS MATERIALIZED (SELECT qid, id, rank, score, CASE WHEN done THEN x ELSE n END AS x, {now} AS done FROM (
    SELECT z.*, {own} + {came} * coalesce(m.m, 0) AS n FROM {name}_{i} z LEFT JOIN (SELECT p.qid, p.dst, sum(p.p * y.x) AS m
    FROM {modes[mode]}t p JOIN {name}_{i} y ON p.qid = y.qid AND p.src = y.id GROUP BY p.qid, p.dst) m ON z.qid = m.qid AND z.id = m.dst))"""
        out += f""", {name}_r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(x, 6) DESC, rank) AS r FROM {name}_{steps}),
{name}_h AS (SELECT g.qid, count(*) AS n_gt, min(coalesce(f.r, b.rank)) AS first, count(*) FILTER (coalesce(f.r, b.rank) <= 10) AS n10
    FROM gt g JOIN ranked b ON g.qid = b.qid AND g.id = b.id LEFT JOIN {name}_r f ON g.qid = f.qid AND g.id = f.id GROUP BY g.qid)"""
        parts.append(f"""SELECT '{name}' AS variant, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(coalesce(n10, 0) / greatest(coalesce(n_gt, 0), 1)), 6) AS recall10,
    count(*) AS n_queries FROM ask LEFT JOIN {name}_h h ON ask.qid = h.qid""")
    return f"{out} {' UNION ALL '.join(parts)}"


@query(_sweep_sql())
def variant_sweep(spark, sf_dir):
    """All 28 named variants: mean reciprocal rank and recall of each. Candidates are scored and ranked once, and only
    relevant ones are told to the variants: a candidate outside the shortlist keeps its rank."""
    base = cut(ranked(spark, sf_dir))
    short = base.filter("rank <= 50")
    p = metrics.union_all([matrix(spark, sf_dir, short, m).withColumn("mode", F.lit(m)) for m in WEIGHT_MODES])
    new = graph.sweep(short, p).withColumn("refined", F.round("refined", 6))
    new = new.withColumn("r", F.row_number().over(ranking.Window.partitionBy("qid", "variant").orderBy(F.desc("refined"), "rank")))
    names = F.explode(F.array(*[F.lit(v[0]) for v in graph.VARIANTS])).alias("variant")
    want = base.filter("label = q_label").select("qid", "id", "rank", names)
    want = want.join(new.select("qid", "id", "variant", "r"), ["qid", "id", "variant"], "left").withColumn("r", F.coalesce("r", "rank"))
    want = want.groupBy("qid", "variant").agg(F.count("*").alias("n_gt"), F.min("r").alias("first"), F.count_if(F.col("r") <= 10).alias("n10"))
    d = source(spark, sf_dir, "ask").select("qid", names).join(want, ["qid", "variant"], "left")
    return d.groupBy("variant").agg(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
                                    F.round(F.avg(F.coalesce("n10", F.lit(0)) / F.greatest(F.coalesce("n_gt", F.lit(0)), F.lit(1))), 6).alias("recall10"),
                                    F.count("*").alias("n_queries"))
