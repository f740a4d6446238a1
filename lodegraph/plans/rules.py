"""Rules for single elements, boxes, tokens and queries, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes, text
from ..functions import vectors as V
from ..operators import graph, linking, losses, metrics
from .base import query, source
from .documents import elements
from .retrieval import SCORED, TRUTH, ranked, scored, truth

_RAW = "CASE q % 8 WHEN 0 THEN 'image' WHEN 1 THEN 'figure' WHEN 2 THEN 'table' WHEN 3 THEN 'caption' WHEN 4 THEN 'equation' WHEN 5 THEN 'drawing' WHEN 6 THEN 'text' END"
_LAYOUT = "CASE q % 9 WHEN 0 THEN 'section_header' WHEN 1 THEN 'formula' WHEN 2 THEN 'list_item' WHEN 3 THEN 'footnote' WHEN 4 THEN 'page_header' WHEN 5 THEN 'title' WHEN 6 THEN 'caption' WHEN 7 THEN 'other' END"
_JUDGED = "CASE p % 5 WHEN 0 THEN ' Yes, it is' WHEN 1 THEN 'partially right' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'No' END"


@query(f"""WITH e AS (SELECT id, {_RAW} AS raw, {_LAYOUT} AS layout, {_JUDGED} AS judged, concat(CAST(doc_id AS STRING), CASE WHEN q % 3 = 0 THEN '__x' ELSE '__p' END, CAST(ord AS STRING)) AS par,
  concat('2101.0', CAST(p AS STRING), CASE WHEN q % 2 = 0 THEN concat('v', CAST(n AS STRING)) ELSE '' END) AS paper, CASE WHEN q % 2 = 0 THEN concat(type, '_', type) ELSE concat(type, '_', title) END AS name,
  CASE WHEN q % 3 = 0 THEN '' WHEN q % 3 = 1 THEN repeat(body, 12) END AS words, CASE WHEN p % 2 = 0 THEN caption END AS said, p FROM element)
SELECT id, CASE WHEN contains(par, '__p') THEN try_cast(split_part(par, '__p', -1) AS INT) END AS paragraph, regexp_replace(paper, 'v\\d+$', '') AS paper,
 CASE WHEN length(name) % 2 = 1 AND substr(name, 1, length(name) // 2) = substr(name, length(name) // 2 + 2) THEN substr(name, 1, length(name) // 2) ELSE name END AS name,
 CASE WHEN raw = 'image' THEN 'figure' WHEN raw IN ('figure', 'table', 'caption', 'equation') THEN raw ELSE 'text' END AS type,
 CASE WHEN layout IN ('section_header', 'title') THEN 'section_header' WHEN layout = 'formula' THEN 'equation' WHEN layout = 'list_item' THEN 'text' WHEN layout = 'caption' THEN 'caption' END AS layout,
 substr(coalesce(nullif(words, ''), nullif(said, ''), '(empty)'), 1, 512) AS words,
 CASE WHEN judged LIKE ' Yes%' THEN 1.0 WHEN lower(judged) LIKE 'partial%' THEN 0.5 ELSE 0 END::DOUBLE AS verdict,
 CASE WHEN ('0x' || substr(md5('3:' || id), 1, 8))::BIGINT % 100 < 33 THEN 'caption' WHEN ('0x' || substr(md5('3:' || id), 1, 8))::BIGINT % 100 < 67 THEN 'reference' ELSE 'question' END AS anchor FROM e""")
def element_rules(spark, sf_dir):
    """Numbers, names, kinds, fallbacks and verdicts of single elements."""
    c = F.col
    d = elements(spark, sf_dir)
    par = F.concat(c("doc_id").cast("string"), F.when(c("q") % 3 == 0, "__x").otherwise("__p"), c("ord").cast("string"))
    paper = F.concat(F.lit("2101.0"), c("p").cast("string"), F.when(c("q") % 2 == 0, F.concat(F.lit("v"), c("n").cast("string"))).otherwise(""))
    name = F.concat("type", F.lit("_"), F.when(c("q") % 2 == 0, c("type")).otherwise(c("title")))
    words = F.when(c("q") % 3 == 0, "").when(c("q") % 3 == 1, F.repeat("body", F.lit(12)))
    return d.select("id", text.paragraph_number(par).alias("paragraph"), text.without_version(paper).alias("paper"), text.halved(name).alias("name"), text.element_type(F.expr(_RAW)).alias("type"),
                    text.layout_type(F.expr(_LAYOUT)).alias("layout"), text.first_text(words, F.when(c("p") % 2 == 0, c("caption"))).alias("words"), metrics.verdict(F.expr(_JUDGED)).alias("verdict"),
                    linking.anchor_kind(3, "id").alias("anchor"))


@query("""SELECT id, round(x0 * 2, 6) AS sx0, round(y1 * 0.5, 6) AS sy1, round(1000 - y1, 6) AS fy0, round(1000 - y0, 6) AS fy1, round(x1 / 612.0, 6) AS rx1, round(y0 / 792.0, 6) AS ry0 FROM element""")
def boxes_moved(spark, sf_dir):
    """Boxes in other units, upside down, and relative to their page."""
    box = boxes.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    s, f, r = boxes.scaled(box, F.lit(2.0), F.lit(0.5)), boxes.flipped(box, F.lit(1000.0)), boxes.relative(box, F.lit(612.0), F.lit(792.0))
    told = {"sx0": s["x0"], "sy1": s["y1"], "fy0": f["y0"], "fy1": f["y1"], "rx1": r["x1"], "ry0": r["y0"]}
    return elements(spark, sf_dir).select("id", *[F.round(v, 6).alias(k) for k, v in told.items()])


@query("""WITH k0 AS (SELECT id, unnest(range(4)) AS k, v FROM vec), k AS (SELECT id, k, [x::DOUBLE / sqrt(list_sum([y::DOUBLE * y FOR y IN v[16 * k + 1:16 * k + 16]])) FOR x IN v[16 * k + 1:16 * k + 16]] AS t FROM k0), j AS (SELECT unnest(range(16)) AS j),
m AS (SELECT id, j, sum(CASE WHEN (id + k) % 3 <> 0 THEN t[j + 1] ELSE 0 END) / greatest(sum(((id + k) % 3 <> 0)::INT), 1) AS x FROM k, j GROUP BY id, j),
n AS (SELECT id, sqrt(sum(x * x)) AS n FROM m GROUP BY id)
SELECT m.id, j::INT AS place, round(x / n, 6) AS x FROM m JOIN n ON m.id = n.id""")
def pooled_tokens(spark, sf_dir):
    """The unit vector of the mean of each element's valid tokens: four of sixteen places, of which some are masked."""
    valid = F.array(*[(F.col("id") + i) % 3 != 0 for i in range(4)])
    d = source(spark, sf_dir, "vec").select("id", F.posexplode(V.mean_pool(V.token_matrix(F.col("v"), 4, 16), valid, 16)).alias("place", "x"))
    return d.select("id", "place", F.round("x", 6).alias("x"))


@query("""WITH i AS (SELECT unnest(range(64)) AS i) SELECT id, i::INT AS place, round(v[i + 1]::DOUBLE / (1 + exp(3.0 - label)) + v[64 - i]::DOUBLE / (1 + exp(-(id % 5)::DOUBLE)) + 0.5 * label, 6) AS x FROM vec, i""")
def gated_facets(spark, sf_dir):
    """A sum of three facets of each element, each times the sigmoid of its gate."""
    c = F.col
    facets = [(c("v"), (c("label") - 3).cast("double")), (F.reverse("v"), (c("id") % 5).cast("double")), (F.array_repeat(c("label").cast("double"), 64), F.lit(0.0))]
    d = source(spark, sf_dir, "vec").select("id", F.posexplode(V.gated_sum(facets)).alias("place", "x"))
    return d.select("id", "place", F.round("x", 6).alias("x"))


@query(f"""WITH {SCORED}, {TRUTH}, g AS (SELECT gt.qid, list(DISTINCT gt.id % 7) AS pages FROM gt GROUP BY gt.qid),
t AS (SELECT qid, list(DISTINCT id % 7) AS pages FROM ranked WHERE rank <= 10 GROUP BY qid)
SELECT t.qid, CASE WHEN len(g.pages) > 1 THEN list_has_all(t.pages, g.pages)::INT::DOUBLE END AS hit FROM t LEFT JOIN g ON t.qid = g.qid""")
def cross_page_hits(spark, sf_dir):
    """Whether all pages of the ground truth are among those of the ten best; null with one page or none."""
    gt = truth(spark, sf_dir).select("qid", F.transform("gt", lambda x: x % 7).alias("gt_pages"))
    best = ranked(spark, sf_dir).filter("rank <= 10").groupBy("qid").agg(F.collect_set(F.col("id") % 7).alias("top_pages"))
    return best.join(gt, "qid").select("qid", metrics.cross_page_hit(F.col("gt_pages"), F.col("top_pages")).alias("hit"))


@query(f"WITH {SCORED} SELECT qid, id, score AS refined, round(score + 0.3 * (id % 5) + 0.5 * (id % 3), 6) AS total FROM scored")
def unpropagated(spark, sf_dir):
    """Scores that no method refines, and the total of three losses."""
    d = graph.propagate(scored(spark, sf_dir), None, "none")
    total = losses.total(F.col("score"), (F.col("id") % 5).cast("double"), (F.col("id") % 3).cast("double"))
    return d.select("qid", "id", "refined", F.round(total, 6).alias("total"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN type = 'section_header' THEN level ELSE level + 1 END AS depth, p % 5 = 0 AS matched FROM element)
SELECT doc_id, depth, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY doc_id), 6) AS share, round(avg(matched::INT), 6) AS coverage FROM d GROUP BY doc_id, depth""")
def section_depths(spark, sf_dir):
    """How many elements of a paper lie at each depth of its sections, and how many of them were matched."""
    depth = F.when(F.col("type") == "section_header", F.col("level")).otherwise(F.col("level") + 1)
    d = elements(spark, sf_dir).groupBy("doc_id", depth.alias("depth")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("p") % 5 == 0).cast("int")), 6).alias("coverage"))
    return d.join(d.groupBy("doc_id").agg(F.sum("n").alias("all")), "doc_id").select("doc_id", "depth", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"), "coverage")


@query()
def alike_visuals(spark, sf_dir):
    """Figures and the visuals of their document and type whose captions are most alike; tests hold them against difflib."""
    d = elements(spark, sf_dir).filter("type IN ('figure', 'table')").select("doc_id", "id", "type", "ord", F.col("body").alias("text"))
    return linking.alike_visuals(d.filter("ord % 2 = 0").withColumnRenamed("id", "file"), d.filter("ord % 2 = 1"))
