"""Queries over elements of documents: text rules, sections, edges, boxes, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, text
from ..operators import linking, metrics, sections, stats
from ..operators.ranking import Window, longest_prefix, order_key
from .base import query, source




def elements(spark, sf_dir) -> DataFrame:
    return source(spark, sf_dir, "element")


def _is_header():
    return F.col("type") == "section_header"


# Text rules.

_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(trim(title), '^\s*(?i:sec\.?|section|appendix|app\.?|chap\.?|chapter)\s*\d*(?:\.\d+)*\s*[.:]?\s*', ''),
 '^\s*\d+(?:\.\d+){0,3}\s+', ''), '^\s*[A-Z]\.\s+', '')"""
_HEADINGS = rf"""h0 AS (SELECT DISTINCT title FROM element), h1 AS (SELECT title, {_NORMAL} AS t FROM h0),
h2 AS (SELECT title, t, [x for x in regexp_split_to_array(t, '\s+') if x <> ''] AS k FROM h1),
heading AS (SELECT title, lower(trim(CASE WHEN len(k) > 0 AND len([x for x in k if length(x) = 1]) >= len(k) * 0.4 THEN array_to_string(k, '') ELSE t END)) AS n FROM h2)"""


@query(f"WITH {_HEADINGS} SELECT title, n FROM heading")
def heading_normalise(spark, sf_dir):
    return elements(spark, sf_dir).select("title").distinct().select("title", text.normal_heading(F.col("title")).alias("n"))


def _role_sql(roles, c: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains({c}, '{w}')''' for w in words)} THEN '{r}'" for r, words in roles) + " ELSE 'other' END"


@query(f"WITH {_HEADINGS} SELECT title, {_role_sql(text.ROLES_LAYOUT, 'n')} AS layout, {_role_sql(text.ROLES_PAPERS, 'lower(title)')} AS papers, "
       f"{_role_sql(text.ROLES_CONTENT_LIST, 'lower(title)')} AS listed, {_role_sql(text.ROLES_EXTRACTOR, 'lower(title)')} AS extracted, "
       f"{_role_sql(text.ROLES_LATEX, 'lower(title)')} AS latex FROM heading")
def section_role(spark, sf_dir):
    t = F.col("title")
    raw = lambda r: text.role(t, r, normalise=False)
    return elements(spark, sf_dir).select("title").distinct().select(
        "title", text.role(t).alias("layout"), raw(text.ROLES_PAPERS).alias("papers"), raw(text.ROLES_CONTENT_LIST).alias("listed"),
        raw(text.ROLES_EXTRACTOR).alias("extracted"), raw(text.ROLES_LATEX).alias("latex"))


def _kind_sql(c: str) -> str:
    return f"CASE WHEN lower({c}) LIKE 'fig%' THEN 'figure' WHEN lower({c}) LIKE 'tab%' THEN 'table' WHEN lower({c}) LIKE 'alg%' THEN 'algorithm' WHEN lower({c}) LIKE 'eq%' THEN 'equation' ELSE rtrim(lower({c}), '.') END"


def _label_sql(c: str, pattern: str, gap: str) -> str:
    k, n = (f"regexp_extract({c}, '{pattern}', {i})" for i in (1, 2))
    return f"CASE WHEN {n} <> '' THEN concat({_kind_sql(k)}, '{gap}', {n}) END"


_ANCHORED = r"^\s*((?i:figure|fig\.?|table|tab\.?|algorithm|alg\.?))\s*(\d+(?:\.\d+)?)"
_INLINE = r"(?:^|[^\p{L}\p{N}_])((?i:figure|fig\.?|table|tab\.?))\s*([0-9]+(?:\.[0-9]+)?)"
_CAPTION = r"^\s*((?i:figure|fig\.?|table|tab\.?))\s*([0-9]+(?:\.[0-9]+)?)[:.]\s*"


@query(f"SELECT DISTINCT caption, {_label_sql('caption', _ANCHORED, ' ')} AS anchored, {_label_sql('caption', _INLINE, '')} AS inline, {_label_sql('caption', _CAPTION, '')} AS shaped FROM element")
def label_parse(spark, sf_dir):
    c = F.col("caption")
    return elements(spark, sf_dir).select("caption").distinct().select(
        "caption", text.anchored_label(c).alias("anchored"), text.inline_label(c).alias("inline"), text.caption_label(c).alias("shaped"))


_ROLE_WORDS = "|".join(w for _, ws in text.ROLES_LAYOUT for w in ws)


@query(rf"""SELECT DISTINCT title, length(trim(title)) BETWEEN 3 AND 120 AND regexp_matches(trim(title), '(?i)^\s*(?:(?:[1-9]\d?\.?)+\s+[A-Z]|(?:section|sec\.?|appendix|app\.?)\s+[A-Z\d]|(?:{_ROLE_WORDS}))') AS heading,
CASE WHEN regexp_extract(title, '^\s*(\d+(?:\.\d+){{0,3}})\.?\s+', 1) <> '' THEN len(string_split(regexp_extract(title, '^\s*(\d+(?:\.\d+){{0,3}})\.?\s+', 1), '.'))
 WHEN regexp_matches(title, '(?i)^\s*[IVXLCDM]+\.\s+') THEN 1 WHEN regexp_matches(title, '^\s*[A-Z]\.\s+') THEN 2 ELSE 1 END::INT AS level FROM element""")
def heading_level(spark, sf_dir):
    t = F.col("title")
    return elements(spark, sf_dir).select("title").distinct().select("title", text.is_heading(t).alias("heading"), text.header_level(t).alias("level"))


_REFS = r"(?:^|[^\p{L}\p{N}_])((?i:figure|fig\.?|table|tab\.?|algorithm|alg\.?|equation|eq\.?))\s*(\d+(?:\.\d+)?)"
_REFERENCES = f"""x0 AS (SELECT doc_id, id, unnest(regexp_extract_all(body, '{_REFS}', 1)) AS k, unnest(regexp_extract_all(body, '{_REFS}', 2)) AS m FROM element WHERE type = 'text'),
ref AS (SELECT doc_id, id, concat({_kind_sql('k')}, ' ', m) AS label FROM x0)"""


@query(f"WITH {_REFERENCES} SELECT label, count(*) AS n, count(DISTINCT id) AS n_elements FROM ref GROUP BY label")
def inline_references(spark, sf_dir):
    d = elements(spark, sf_dir).filter("type = 'text'").select("id", F.explode(text.inline_references(F.col("body"))).alias("label"))
    return d.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_elements"))


_CAP_LABEL = _label_sql('caption', _ANCHORED, ' ')
_LABELS = f"""lab0 AS (SELECT doc_id, id, ord, type, {_CAP_LABEL} AS label FROM element),
lab1 AS (SELECT doc_id, label, max_by(id, ord) AS id FROM lab0 WHERE type = 'caption' AND label IS NOT NULL GROUP BY doc_id, label),
labels_of AS (SELECT * FROM lab1 UNION ALL SELECT doc_id, label, min_by(id, ord) FROM lab0 WHERE type IN ('figure', 'table') AND label IS NOT NULL
  AND (doc_id, label) NOT IN (SELECT (doc_id, label) FROM lab1) GROUP BY doc_id, label)"""


def labels(spark, sf_dir) -> DataFrame:
    d = elements(spark, sf_dir).select("doc_id", "id", "ord", "type", text.anchored_label(F.col("caption")).alias("label"))
    return linking.label_table(d.filter("type = 'caption'"), d.filter("type IN ('figure', 'table')"))


@query(f"WITH {_LABELS} SELECT doc_id, label, id FROM labels_of")
def label_lookup_lastwins(spark, sf_dir):
    return labels(spark, sf_dir).select("doc_id", "label", "id")


@query(f"WITH {_LABELS}, {_REFERENCES} SELECT DISTINCT ref.doc_id, ref.id AS src, labels_of.id AS dst FROM ref JOIN labels_of ON ref.doc_id = labels_of.doc_id AND ref.label = labels_of.label")
def refer_to_edges(spark, sf_dir):
    d = elements(spark, sf_dir).filter("type = 'text'").withColumn("refs", text.inline_references(F.col("body")))
    return linking.refer_to(d, labels(spark, sf_dir))


_WORD_REF = r"\b(?:(?i:figure|fig\.?|table|tab\.?|algorithm|alg\.?|equation|eq\.?))\s*\d+(?:\.\d+)?"
_CITED = r"\[\d+(?:,\s*\d+)*\]"


@query(f"""WITH r0 AS (SELECT id, body, regexp_extract_all(body, '{_WORD_REF}') AS m, regexp_split_to_array(body, '{_WORD_REF}') AS g FROM element WHERE type = 'text'),
r1 AS (SELECT id, body, m, unnest(range(1, len(m) + 1)) AS i, list_sum([length(x) FOR x IN g[1:i]]) + list_sum([length(x) FOR x IN m[1:i - 1]] || [0]) AS beg FROM r0),
r2 AS (SELECT id, m[i] AS t, beg, substr(body, (greatest(beg - 8, 0) + 1)::INT, (beg - greatest(beg - 8, 0))::INT) AS before,
  substr(body, (greatest(beg - 50, 0) + 1)::INT, (beg + length(m[i]) + 50 - greatest(beg - 50, 0))::INT) AS around FROM r1)
SELECT id, concat({_kind_sql("regexp_extract(t, '^([A-Za-z]+[.]?)', 1)")}, ' ', regexp_extract(t, '([0-9.]+)$', 1)) AS label,
 CASE WHEN regexp_matches(around, '{_CITED}') AND beg < 20 THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM r2 WHERE NOT regexp_matches(before, '{_CITED}')""")
def references_uncited(spark, sf_dir):
    """References that no citation stands right before; the confidence is lower for one near the start with a citation in reach."""
    d = elements(spark, sf_dir).filter("type = 'text'").select("id", F.explode(text.references_with_context(F.col("body"))).alias("r"))
    return d.filter(~text.cited(F.col("r.before"))).select("id", "r.label", F.when(text.cited(F.col("r.around")) & (F.col("r.start") < 20), 0.5).otherwise(0.9).alias("confidence"))


@query(r"""SELECT DISTINCT caption, lower(trim(regexp_replace(regexp_replace(caption, '^\s*(?i:figure|fig\.?|table|tab\.?)\s*[0-9]+(?:\.[0-9]+)?[:.]\s*', ''), '\s+', ' ', 'g'))) AS normal,
trim(regexp_replace(caption, '^\s*(?i:figure|fig\.?|table|tab\.?|algorithm|alg\.?)\s*\d+(?:\.\d+)?[: ]*', '')) AS body FROM element""")
def caption_normalise(spark, sf_dir):
    c = F.col("caption")
    return elements(spark, sf_dir).select("caption").distinct().select("caption", text.normal_caption(c).alias("normal"), text.caption_body(c).alias("body"))


# Order, sections, edges.


@query("SELECT doc_id, id, CAST(regexp_extract(id, '__p(\\d+)__e(\\d+)$', 1) AS INT) AS k1, CAST(regexp_extract(id, '__p(\\d+)__e(\\d+)$', 2) AS INT) AS k2 FROM element")
def reading_order(spark, sf_dir):
    k1, k2 = order_key(F.col("doc_id").cast("string"), F.col("id"))
    return elements(spark, sf_dir).select("doc_id", "id", k1.alias("k1"), k2.alias("k2"))


_SESSION = "sess AS (SELECT *, sum((type = 'section_header')::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS section FROM element)"


def sessions(spark, sf_dir) -> DataFrame:
    return sections.sessions(elements(spark, sf_dir), _is_header())


@query(f"WITH {_SESSION} SELECT doc_id, section::BIGINT AS section, count(*) AS n, min(ord) AS first, max(ord) AS last FROM sess GROUP BY doc_id, section")
def section_sessionise(spark, sf_dir):
    return sessions(spark, sf_dir).groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"))


_MERGE = f"""{_SESSION}, sz AS (SELECT doc_id, section, count(*) AS n FROM sess GROUP BY doc_id, section),
own AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY section) = 1 OR n >= 8 THEN section END AS own FROM sz),
mg AS (SELECT doc_id, section, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section) AS kept FROM own)"""


@query(f"WITH {_MERGE} SELECT s.doc_id, s.id, kept::BIGINT AS kept_section FROM sess s JOIN mg ON s.doc_id = mg.doc_id AND s.section = mg.section")
def section_merge(spark, sf_dir):
    return sections.merged(sessions(spark, sf_dir)).select("doc_id", "id", "kept_section")


def _paths_sql(one: bool) -> str:
    up = ", ".join(f"sum((level < {n})::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS a{n}" for n in (1, 2, 3))
    ct = ", ".join(f"sum((level = {n})::INT) OVER (PARTITION BY doc_id, a{n} ORDER BY ord) AS c{n}" for n in (1, 2, 3))
    part = ", ".join(f"CASE WHEN level >= {n} AND c{n} > 0 THEN {'1' if one else f'c{n}'} END" for n in (1, 2, 3))
    return f"""WITH h AS (SELECT * FROM element WHERE type = 'section_header'), u AS (SELECT *, {up} FROM h), c AS (SELECT *, {ct} FROM u)
SELECT doc_id, id, array_to_string([x for x in [{part}] if x IS NOT NULL], '.') AS path FROM c"""


def _paths(spark, sf_dir, compat: bool) -> DataFrame:
    d = sections.paths(elements(spark, sf_dir).filter(_is_header()), depth=3, compat=compat)
    return d.select("doc_id", "id", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"))


@query(_paths_sql(False))
def section_paths(spark, sf_dir):
    return _paths(spark, sf_dir, False)


@query(_paths_sql(True))
def section_paths_compat(spark, sf_dir):
    return _paths(spark, sf_dir, True)


@query(f"WITH {_SESSION} SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id, section ORDER BY ord)::INT AS place FROM sess")
def place_in_section(spark, sf_dir):
    return sections.place_in_section(sessions(spark, sf_dir)).select("doc_id", "id", "place")


@query(f"""WITH {_SESSION}, k AS (SELECT *, CASE WHEN p % 3 = 0 THEN q END AS number FROM sess)
SELECT doc_id, id, round((row_number() OVER (PARTITION BY doc_id, section ORDER BY number IS NULL, number, ord) - 1) / count(*) OVER (PARTITION BY doc_id, section), 6) AS intra_pos FROM k""")
def node_features(spark, sf_dir):
    """Places in sections; each third element has the id of a paragraph, which tells its number."""
    paragraph = F.concat(F.col("doc_id").cast("string"), F.lit("__p"), F.lpad(F.col("q").cast("string"), 3, "0"))
    d = sessions(spark, sf_dir).withColumns({"own": F.col("id"), "id": F.when(F.col("p") % 3 == 0, paragraph).otherwise(F.col("id"))})
    return sections.inner_place(d).select("doc_id", F.col("own").alias("id"), F.round("intra_pos", 6).alias("intra_pos"))


_R = _role_sql(text.ROLES_CONTENT_LIST, "lower(title)")


@query(f"""WITH r AS (SELECT doc_id, id, ord, CASE WHEN type = 'section_header' AND level <= 2 THEN {_R} END AS own FROM element)
SELECT doc_id, id, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord) AS inherited FROM r""")
def inherited_role(spark, sf_dir):
    role = text.role(F.col("title"), text.ROLES_CONTENT_LIST, normalise=False)
    d = elements(spark, sf_dir).withColumn("role", role).withColumn("level", F.when(_is_header(), F.col("level")))
    return sections.inherited_role(d).select("doc_id", "id", "inherited")


@query(f"WITH {_SESSION}, l AS (SELECT doc_id, id AS src, lead(id) OVER (PARTITION BY doc_id, section ORDER BY ord) AS dst FROM sess) SELECT doc_id, src, dst, 'reading_next' AS type FROM l WHERE dst IS NOT NULL")
def reading_next_edges(spark, sf_dir):
    return sections.adjacent(sessions(spark, sf_dir), ["doc_id"], "reading_next", within="section").select("doc_id", "src", "dst", "type")


@query("WITH l AS (SELECT doc_id, id AS src, lead(id) OVER (PARTITION BY doc_id ORDER BY ord) AS dst FROM element) SELECT src, dst, 'next' AS type FROM l WHERE dst IS NOT NULL UNION ALL SELECT dst, src, 'prev' FROM l WHERE dst IS NOT NULL")
def next_prev_edges(spark, sf_dir):
    d = sections.adjacent(elements(spark, sf_dir), ["doc_id"], "next").select("src", "dst")
    both = F.array(F.struct("src", "dst", F.lit("next").alias("type")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("prev").alias("type")))
    return d.select(F.explode(both).alias("e")).select("e.*")


@query("WITH h AS (SELECT doc_id, id AS src, lead(id) OVER (PARTITION BY doc_id ORDER BY ord) AS dst FROM element WHERE type = 'section_header') SELECT doc_id, src, dst FROM h WHERE dst IS NOT NULL")
def section_next_edges(spark, sf_dir):
    return sections.adjacent(elements(spark, sf_dir).filter(_is_header()), ["doc_id"], "section_next").select("doc_id", "src", "dst")


@query("""WITH h AS (SELECT *, last_value(CASE WHEN type = 'section_header' THEN id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord) AS head FROM element)
SELECT doc_id, head AS src, id AS dst FROM h WHERE head IS NOT NULL AND head <> id""")
def contains_edges(spark, sf_dir):
    d = elements(spark, sf_dir).withColumn("head", sections.last_header(_is_header(), "id"))
    return d.filter("head <> id").select("doc_id", F.col("head").alias("src"), F.col("id").alias("dst"))


@query("SELECT doc_id, concat(CAST(doc_id AS STRING), '__e', lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS STRING), 4, '0')) AS eid FROM element WHERE type <> 'section_header'")
def running_ids(spark, sf_dir):
    return sections.running_ids(elements(spark, sf_dir).filter(~_is_header())).select("doc_id", "eid")


@query("""WITH m AS (SELECT doc_id, id, type, lag(type) OVER w AS b, lag(id) OVER w AS c FROM element WHERE type IN ('figure', 'table', 'caption') WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord))
SELECT doc_id, id, CASE WHEN b = 'caption' THEN c END AS caption FROM m WHERE type <> 'caption'""")
def pending_captions(spark, sf_dir):
    return sections.pending_captions(elements(spark, sf_dir))


@query("""WITH c AS (SELECT * FROM element WHERE type = 'caption'), v AS (SELECT * FROM element WHERE type IN ('figure', 'table')),
j AS (SELECT c.doc_id, c.id AS caption, v.id AS visual, abs(v.ord - c.ord) AS gap, row_number() OVER (PARTITION BY c.id ORDER BY abs(v.ord - c.ord), v.ord) AS r
 FROM c JOIN v ON c.doc_id = v.doc_id AND abs(v.ord - c.ord) <= 3) SELECT doc_id, caption, visual, gap FROM j WHERE r = 1""")
def caption_proximity(spark, sf_dir):
    return linking.nearby_visual(elements(spark, sf_dir))


@query("""SELECT e.doc_id, e.id, h.title AS section FROM element e ASOF LEFT JOIN (SELECT doc_id, ord, title FROM element WHERE type = 'section_header') h
ON e.doc_id = h.doc_id AND e.ord >= h.ord""")
def asof_section(spark, sf_dir):
    return elements(spark, sf_dir).select("doc_id", "id", sections.last_header(_is_header(), "title").alias("section"))


@query("""WITH v AS (SELECT *, CASE WHEN p % 10 = 0 THEN title END AS known FROM element)
SELECT doc_id, id, coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord), first_value(known IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM v""")
def fill_both_ways(spark, sf_dir):
    d = elements(spark, sf_dir).withColumn("known", F.when(F.col("p") % 10 == 0, F.col("title")))
    return d.select("doc_id", "id", sections.filled("known").alias("filled"))


@query("""WITH n AS (SELECT doc_id, page, title, count(*) AS n, min(ord) AS o FROM element GROUP BY doc_id, page, title)
SELECT doc_id, page, arg_min(title, (-n, o)) AS title, max(n) AS n FROM n GROUP BY doc_id, page""")
def plurality_section(spark, sf_dir):
    return sections.plurality(elements(spark, sf_dir), ["doc_id", "page"], "title")


@query("""WITH d AS (SELECT doc_id, text FROM documents), p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM d)
SELECT doc_id, i::INT AS place, length(trim(t))::INT AS n FROM p WHERE trim(t) <> ''""")
def paragraph_elements(spark, sf_dir):
    from ..sources.text import paragraphs

    d = paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", separator="\n")
    return d.select("doc_id", "place", F.length("text").alias("n"))


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<(h1|p|li)>([^<]*)', 1)) AS tag, unnest(regexp_extract_all(html, '<(h1|p|li)>([^<]*)', 2)) AS body,
 unnest(range(len(regexp_extract_all(html, '<(h1|p|li)>([^<]*)', 1)))) AS i FROM pages)
SELECT page_id, i::INT AS place, CASE tag WHEN 'h1' THEN 'section_header' ELSE 'text' END AS type, length(body)::INT AS n FROM t""")
def html_elements(spark, sf_dir):
    from ..sources.text import html_elements as read

    return read(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").select("page_id", "place", "type", F.length("text").alias("n"))


# Boxes.

_I = "greatest(least(x1, gx1) - greatest(x0, gx0), 0) * greatest(least(y1, gy1) - greatest(y0, gy0), 0)"
_A = "(greatest(x1 - x0, 0) * greatest(y1 - y0, 0))"
_G = "(greatest(gx1 - gx0, 0) * greatest(gy1 - gy0, 0))"


def _boxes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = F.col
    t = source(spark, sf_dir, "truth").select("doc_id", "page", "gt_id", boxes.box(c("gx0"), c("gy0"), c("gx1"), c("gy1")).alias("gt_box"))
    return t, elements(spark, sf_dir).select("doc_id", "page", "id", "ord", boxes.box(c("x0"), c("y0"), c("x1"), c("y1")).alias("box"))


@query(f"SELECT gt_id, id, round({_I} / {_A}, 6) AS share FROM truth t JOIN element e ON t.doc_id = e.doc_id AND t.page = e.page WHERE {_A} > 0 AND {_I} / {_A} >= 0.7")
def bbox_containment(spark, sf_dir):
    return linking.contained_boxes(*_boxes(spark, sf_dir)).select("gt_id", "id", F.round("share", 6).alias("share"))


@query(f"""WITH j AS (SELECT gt_id, id, ord, {_I} / ({_A} + {_G} - {_I}) AS iou FROM truth t JOIN element e ON t.doc_id = e.doc_id AND t.page = e.page),
r AS (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY iou DESC, ord) AS r FROM j) SELECT gt_id, id, round(iou, 6) AS iou FROM r WHERE r = 1 AND iou >= 0.5""")
def bbox_best_iou(spark, sf_dir):
    return linking.best_box(*_boxes(spark, sf_dir)).select("gt_id", "id", F.round("iou", 6).alias("iou"))


@query(f"""SELECT round(avg({_I} / ({_A} + {_G} - {_I})), 6) AS iou, round(avg(greatest(greatest(y0, gy0) - least(y1, gy1), 0)), 6) AS gap, count(*) AS n
FROM truth t JOIN element e ON t.doc_id = e.doc_id AND t.page = e.page AND concat('gt', e.id) = gt_id""")
def localization(spark, sf_dir):
    t, e = _boxes(spark, sf_dir)
    d = t.join(e.withColumn("gt_id", F.concat(F.lit("gt"), "id")), ["doc_id", "page", "gt_id"])
    return d.agg(F.round(F.avg(boxes.iou(F.col("gt_box"), F.col("box"))), 6).alias("iou"),
                 F.round(F.avg(boxes.vertical_gap(F.col("gt_box"), F.col("box"))), 6).alias("gap"), F.count("*").alias("n"))


@query("""SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(max(y1) / 900.0, 6) AS extent FROM element WHERE type IN ('figure', 'table')
GROUP BY doc_id, page HAVING (max(x1) - min(x0)) * (max(y1) - min(y0)) > 1000""")
def bbox_union(spark, sf_dir):
    d = elements(spark, sf_dir).filter("type IN ('figure', 'table')").groupBy("doc_id", "page").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return d.filter("(x1 - x0) * (y1 - y0) > 1000").withColumn("extent", F.round(F.col("y1") / 900.0, 6))


# Counts, reports, runs.


@query("SELECT type, count(*) AS n FROM edge GROUP BY type")
def edge_type_counts(spark, sf_dir):
    return source(spark, sf_dir, "edge").groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT type, count(*) AS n, count(DISTINCT doc_id) AS n_docs, round(avg(length(body)), 6) AS mean_chars FROM element GROUP BY type")
def corpus_stats(spark, sf_dir):
    return elements(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg(F.length("body")), 6).alias("mean_chars"))


@query("""WITH c AS (SELECT doc_id, page, count(*) FILTER (p % 5 = 0) AS g FROM element GROUP BY doc_id, page)
SELECT CASE WHEN g >= 4 THEN '4+' ELSE CAST(g AS STRING) END AS bucket, count(*) AS n FROM c GROUP BY 1""")
def gt_histogram(spark, sf_dir):
    d = elements(spark, sf_dir).groupBy("doc_id", "page").agg(F.count_if(F.col("p") % 5 == 0).alias("g"))
    return d.groupBy(F.when(F.col("g") >= 4, "4+").otherwise(F.col("g").cast("string")).alias("bucket")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT doc_id, q, row_number() OVER (PARTITION BY doc_id ORDER BY q) - 1 AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM element) SELECT doc_id, q AS median FROM s WHERE r = n // 2")
def upper_median(spark, sf_dir):
    return stats.upper_median(elements(spark, sf_dir), ["doc_id"], "q")


@query("SELECT round(avg(level), 6) AS mean_depth, max(level) AS max_depth, round(quantile_cont(q, 0.5), 6) AS median, min(q) AS low, max(q) AS high FROM element WHERE type = 'section_header'")
def header_stats(spark, sf_dir):
    return elements(spark, sf_dir).filter(_is_header()).agg(
        F.round(F.avg("level"), 6).alias("mean_depth"), F.max("level").alias("max_depth"), F.round(F.percentile("q", F.lit(0.5)), 6).alias("median"), F.min("q").alias("low"), F.max("q").alias("high"))


@query("SELECT doc_id, count(*) FILTER (q / 50.0 >= 0.9) AS ge_0_9, count(*) FILTER (q / 50.0 >= 0.7) AS ge_0_7, count(*) FILTER (q / 50.0 >= 0.5) AS ge_0_5, count(*) FILTER (q / 50.0 >= 0.3) AS ge_0_3 FROM element GROUP BY doc_id HAVING count(*) >= 3")
def similarity_cuts(spark, sf_dir):
    d = elements(spark, sf_dir).groupBy("doc_id").agg(*stats.cut_counts(F.col("q") / 50.0, (0.9, 0.7, 0.5, 0.3)), F.count("*").alias("n"))
    return d.filter("n >= 3").drop("n")


_METRICS = ["click", "view", "purchase", "error"]


@query("SELECT qid, " + ", ".join(f"round(avg(value) FILTER (metric = '{m}'), 6) AS {m}" for m in _METRICS) + " FROM run GROUP BY qid")
def metrics_pivot(spark, sf_dir):
    long = source(spark, sf_dir, "run").groupBy("qid", "metric").agg(F.round(F.avg("value"), 6).alias("value"))
    return stats.pivot(long, ["qid"], _METRICS)


@query("WITH a AS (SELECT qid, metric, avg(value) / 100 AS v FROM run GROUP BY qid, metric), w AS (SELECT qid, " + ", ".join(f"max(v) FILTER (metric = '{m}') AS {m}" for m in _METRICS)
       + " FROM a GROUP BY qid) SELECT qid, concat('| ', CAST(qid AS STRING), " + ", ".join(f"' | ', coalesce(printf('%5.1f', round({m} * 100, 6)), '-')" for m in _METRICS) + ", ' |') AS line FROM w")
def metrics_report(spark, sf_dir):
    long = source(spark, sf_dir, "run").groupBy("qid", "metric").agg((F.avg("value") / 100).alias("value"))
    return stats.report(stats.pivot(long, ["qid"], _METRICS), ["qid"], _METRICS)


@query("SELECT metric, CAST(floor((step - 1) / 20) AS BIGINT) AS \"window\", round(avg(value), 6) AS mean, count(*) AS n FROM run GROUP BY 1, 2")
def running_means(spark, sf_dir):
    return stats.tumbling(source(spark, sf_dir, "run"), ["metric"]).withColumn("mean", F.round("mean", 6))


@query("SELECT metric, arg_min(step, (-value, step)) AS step, max(value) AS value FROM run GROUP BY metric")
def best_step(spark, sf_dir):
    return stats.best_step(source(spark, sf_dir, "run"), ["metric"])


@query("""WITH m AS (SELECT row_id, metric, qid // 2 AS pair, avg(value) AS v FROM run GROUP BY 1, 2, 3)
SELECT a.metric, round(avg(a.v - b.v), 6) AS diff, count(*) AS n FROM m a JOIN m b ON a.metric = b.metric AND a.pair = b.pair AND a.row_id = 'a' AND b.row_id = 'b' GROUP BY a.metric""")
def paired_diff(spark, sf_dir):
    return _paired(spark, sf_dir).groupBy("metric").agg(F.round(F.avg("diff"), 6).alias("diff"), F.count("*").alias("n"))


def _paired(spark, sf_dir) -> DataFrame:
    d = source(spark, sf_dir, "run").groupBy("row_id", "metric", F.floor(F.col("qid") / 2).alias("pair")).agg(F.avg("value").alias("value"))
    return stats.paired(d.filter("row_id = 'a'"), d.filter("row_id = 'b'"), ["metric", "pair"])


@query("""WITH m AS (SELECT row_id, metric, qid // 2 AS pair, avg(value) AS v FROM run GROUP BY 1, 2, 3),
d AS (SELECT a.v - b.v AS diff, row_number() OVER (ORDER BY a.metric || ':' || a.pair) - 1 AS i FROM m a JOIN m b ON a.metric = b.metric AND a.pair = b.pair AND a.row_id = 'a' AND b.row_id = 'b'),
n AS (SELECT count(*) AS n, avg(diff) AS mean FROM d), b AS (SELECT unnest(range(1000)) AS b), j AS (SELECT unnest(range((SELECT n FROM n))) AS j),
w AS (SELECT b, ('0x' || substr(md5('0:' || b || ':' || j), 1, 8))::BIGINT % n AS i FROM b, j, n),
r AS (SELECT b, avg(diff) AS x FROM w JOIN d ON w.i = d.i GROUP BY b), s AS (SELECT list(x ORDER BY x) AS x FROM r)
SELECT n, round(mean, 6) AS mean, round(x[26], 6) AS lo, round(x[975], 6) AS hi,
 least(1.0, 2 * len([y FOR y IN x IF CASE WHEN mean >= 0 THEN y <= 0 ELSE y >= 0 END]) / 1000.0)::DOUBLE AS p FROM n, s""")
def paired_bootstrap(spark, sf_dir):
    d = stats.bootstrap(_paired(spark, sf_dir).withColumn("key", F.concat_ws(":", "metric", F.col("pair").cast("string"))), "key")
    return d.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")], "p")


@query("SELECT step, least(step / 200.0, 1.0)::DOUBLE AS lr FROM run")
def warm_up(spark, sf_dir):
    return source(spark, sf_dir, "run").select("step", stats.warm_up(F.col("step"), 200).alias("lr"))


@query("""WITH p AS (SELECT unnest(['small', 'small r', 'red', 'red w', 'blue']) AS prefix)
SELECT p_name, arg_max(prefix, length(prefix)) AS prefix FROM (SELECT DISTINCT p_name FROM part) LEFT JOIN p ON starts_with(p_name, prefix) GROUP BY p_name""")
def longest_prefix_match(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct()
    known = spark.createDataFrame([(x,) for x in ("small", "small r", "red", "red w", "blue")], "prefix string")
    return longest_prefix(names, known, "p_name", "prefix")


@query("""WITH r AS (SELECT doc_id, id, type, q, row_number() OVER (PARTITION BY type ORDER BY q > 25 DESC, p % 2 = 0 DESC, q DESC, id) AS r FROM element)
SELECT type, id, q FROM r WHERE r = 1""")
def example_selection(spark, sf_dir):
    w = Window.partitionBy("type").orderBy(F.desc(F.col("q") > 25), F.desc(F.col("p") % 2 == 0), F.desc("q"), "id")
    return elements(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r = 1").select("type", "id", "q")


@query("""WITH a AS (SELECT DISTINCT metric AS name FROM run WHERE row_id = 'a' AND qid < 4), b AS (SELECT DISTINCT type AS name FROM edge UNION SELECT 'click')
SELECT name, 'declared' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT name, 'defined' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def config_gaps(spark, sf_dir):
    a = source(spark, sf_dir, "run").filter("row_id = 'a' AND qid < 4").select(F.col("metric").alias("name")).distinct()
    b = source(spark, sf_dir, "edge").select(F.col("type").alias("name")).union(spark.createDataFrame([("click",)], "name string")).distinct()
    return stats.config_gaps(a, b)


@query("SELECT DISTINCT metric FROM run WHERE row_id = 'a' INTERSECT SELECT DISTINCT metric FROM run WHERE row_id = 'b'")
def common_datasets(spark, sf_dir):
    d = source(spark, sf_dir, "run")
    return d.filter("row_id = 'a'").select("metric").intersect(d.filter("row_id = 'b'").select("metric"))


@query("""SELECT 'type' AS what, type AS value, count(*) AS n FROM element WHERE type NOT IN ('text', 'figure', 'caption') GROUP BY type
UNION ALL SELECT 'edge', concat(src, ''), 1 FROM (SELECT CAST(dst AS STRING) AS src FROM edge WHERE dst NOT IN (SELECT id FROM vec))""")
def schema_violations(spark, sf_dir):
    """Kinds outside a list, and edges to nodes that do not exist."""
    allowed = spark.createDataFrame([("text",), ("figure",), ("caption",)], "type string")
    kinds = elements(spark, sf_dir).join(allowed, "type", "left_anti").groupBy("type").agg(F.count("*").alias("n"))
    lost = source(spark, sf_dir, "edge").join(source(spark, sf_dir, "vec").select(F.col("id").alias("dst")), "dst", "left_anti")
    return kinds.select(F.lit("type").alias("what"), F.col("type").alias("value"), "n").union(
        lost.select(F.lit("edge"), F.col("dst").cast("string"), F.lit(1).cast("long")))


@query("""SELECT gt.doc_id, count(*) AS n_gt, count(e.id) AS n_found FROM (SELECT doc_id, CASE WHEN gt_ord % 9 = 0 THEN 'missing' ELSE substr(gt_id, 3) END AS id FROM truth) gt LEFT JOIN element e ON gt.id = e.id GROUP BY gt.doc_id""")
def gt_foreign_key(spark, sf_dir):
    gt = source(spark, sf_dir, "truth").select("doc_id", F.when(F.col("gt_ord") % 9 == 0, "missing").otherwise(F.expr("substr(gt_id, 3)")).alias("id"))
    found = elements(spark, sf_dir).select("id", F.lit(1).alias("there"))
    return gt.join(found, "id", "left").groupBy("doc_id").agg(F.count("*").alias("n_gt"), F.count("there").alias("n_found"))


# Answers.

_NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT conv_id, turn, {_NORM} AS a, lead({_NORM}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
w AS (SELECT conv_id, turn, a, b, [x for x in string_split(a, ' ') if x <> ''] AS x, [x for x in string_split(b, ' ') if x <> ''] AS y FROM t WHERE b IS NOT NULL),
n AS (SELECT *, len(list_intersect(x, y)) AS k FROM w)
SELECT conv_id, turn, (a = b)::INT::DOUBLE AS em, round(CASE WHEN k > 0 THEN 2.0 * (k / len(x)) * (k / len(y)) / (k / len(x) + k / len(y)) ELSE 0 END, 6) AS f1 FROM n""")
def token_f1(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    d = d.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next IS NOT NULL")
    return d.select("conv_id", "turn", metrics.exact_match(F.col("text"), F.col("next")).alias("em"), F.round(metrics.token_f1(F.col("text"), F.col("next")), 6).alias("f1"))


# Operators whose results SQL does not give.


@query()
def caption_fuzzy_match(spark, sf_dir):
    d = elements(spark, sf_dir)
    body, label = text.normal_caption(F.col("caption")), text.inline_label(F.col("caption"))
    figures = d.filter("type = 'figure'").select("doc_id", F.col("id").alias("file"), body.alias("text"), label.alias("label"))
    return linking.fuzzy_captions(figures, d.filter("type = 'caption'").select("doc_id", "id", "ord", body.alias("text"), label.alias("label")))


@query()
def greedy_assignment(spark, sf_dir):
    d = elements(spark, sf_dir).filter("type IN ('figure', 'table')").select("doc_id", "id", "type", "ord", F.col("body").alias("text"))
    return linking.assign_greedily(d.filter("ord % 2 = 0"), d.filter("ord % 2 = 1").withColumnRenamed("id", "file"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS r FROM vec),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('0:' || doc_id || ':' || id), id) AS r FROM vec)
SELECT a.doc_id, a.id, a.section_role, b.section_role AS shuffled FROM a JOIN b ON a.doc_id = b.doc_id AND a.r = b.r""")
def shuffled_roles(spark, sf_dir):
    nodes = source(spark, sf_dir, "vec").select("doc_id", "id", F.col("id").alias("ord"), "section_role")
    return linking.shuffled_roles(nodes).select("doc_id", "id", "section_role", "shuffled")


@query("""WITH an AS (SELECT doc_id, id AS anchor FROM vec WHERE id % 50 = 0),
po AS (SELECT DISTINCT src AS anchor, dst AS id FROM edge WHERE src % 50 = 0 AND dst IN (SELECT id FROM vec)),
n AS (SELECT anchor, id, 0 AS k, row_number() OVER (PARTITION BY anchor ORDER BY md5('0:' || anchor || ':' || id), id) AS r FROM po),
f AS (SELECT anchor, vec.id, 1 AS k, row_number() OVER (PARTITION BY anchor ORDER BY md5('0:' || anchor || ':' || vec.id), vec.id) AS r
      FROM an JOIN vec ON an.doc_id = vec.doc_id WHERE anchor <> vec.id AND (anchor, vec.id) NOT IN (SELECT (anchor, id) FROM po)),
b AS (SELECT anchor, id, k = 0 AS positive, row_number() OVER (PARTITION BY anchor ORDER BY k, r) AS place
      FROM (SELECT * FROM n WHERE r <= 4 UNION ALL SELECT * FROM f WHERE r <= 12))
SELECT anchor, id, positive, place::INT AS place FROM b WHERE place <= 12""")
def hard_pool(spark, sf_dir):
    vec, edge = source(spark, sf_dir, "vec"), source(spark, sf_dir, "edge")
    anchors = vec.filter("id % 50 = 0").select("doc_id", F.col("id").alias("anchor"))
    near = edge.select(F.col("src").alias("anchor"), F.col("dst").alias("id")).filter("anchor % 50 = 0").join(vec.select("id"), "id").distinct()
    return linking.hard_pool(anchors, vec.select("doc_id", "id"), near.select("anchor", "id"))
