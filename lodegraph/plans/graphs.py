"""Queries over whole graphs: builders, files, streams and what is left of the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import build, linking, stats
from ..operators.ranking import Window
from ..session import shared_folder
from ..sources import files
from ..streaming import events as stream
from .base import query, source
from .documents import _ANCHORED, _CITED, _HEADINGS, _WORD_REF, _kind_sql, _label_sql, _role_sql


def folder(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _elements(spark, sf_dir):
    d = source(spark, sf_dir, "element")
    body = F.when(F.col("type") == "section_header", F.col("title")).when(F.col("type") == "text", F.col("body")).otherwise(F.col("caption"))
    return d.select("doc_id", "id", "type", body.alias("text"), "page", "ord")


_BUILT = f"""{_HEADINGS}, se AS (SELECT *, sum((type = 'section_header')::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS section FROM element),
sz AS (SELECT doc_id, section, count(*) AS n FROM se GROUP BY 1, 2), ow AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY section) = 1 OR n >= 8 THEN section END AS own FROM sz),
mg AS (SELECT doc_id, section, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section) AS kept FROM ow),
bd0 AS (SELECT se.doc_id, id, ord, page, kept, CASE type WHEN 'section_header' THEN 'text' ELSE type END AS type,
  CASE type WHEN 'section_header' THEN title WHEN 'text' THEN body ELSE caption END AS t FROM se JOIN mg ON se.doc_id = mg.doc_id AND se.section = mg.section),
hs0 AS (SELECT doc_id, kept, CASE kept WHEN 0 THEN 'Front Matter' ELSE arg_min(t, ord) END AS label, min(ord) AS ord FROM bd0 GROUP BY 1, 2),
hs AS (SELECT doc_id, kept, ord, CASE WHEN label = 'Front Matter' THEN 'front_matter' ELSE {_role_sql(text.ROLES_LAYOUT, 'n')} END AS role FROM hs0 LEFT JOIN heading ON title = label),
bd AS (SELECT bd0.*, hs.role, {_label_sql('t', _ANCHORED, ' ')} AS label FROM bd0 JOIN hs ON bd0.doc_id = hs.doc_id AND bd0.kept = hs.kept)"""


@query(f"""WITH {_BUILT}, nd AS (SELECT doc_id, type, role FROM bd UNION ALL SELECT doc_id, 'section_header', role FROM hs)
SELECT type, role AS section_role, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM nd GROUP BY 1, 2""")
def built_graph_nodes(spark, sf_dir):
    nodes, _ = build.build_graph(_elements(spark, sf_dir))
    return nodes.groupBy("type", "section_role").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"""WITH {_BUILT}, cp AS (SELECT c.doc_id, c.id AS caption, c.label, c.ord, v.id AS visual, row_number() OVER (PARTITION BY c.id ORDER BY abs(v.ord - c.ord), v.ord) AS r
  FROM bd c JOIN bd v ON c.doc_id = v.doc_id AND c.type = 'caption' AND v.type IN ('figure', 'table') AND abs(v.ord - c.ord) <= 3),
l1 AS (SELECT doc_id, label, max_by(visual, ord) AS id FROM cp WHERE r = 1 AND label IS NOT NULL GROUP BY 1, 2),
lb AS (SELECT * FROM l1 UNION ALL SELECT doc_id, label, min_by(id, ord) FROM bd WHERE type IN ('figure', 'table') AND label IS NOT NULL AND (doc_id, label) NOT IN (SELECT (doc_id, label) FROM l1) GROUP BY 1, 2),
r0 AS (SELECT doc_id, id, t, regexp_extract_all(t, '{_WORD_REF}') AS m, regexp_split_to_array(t, '{_WORD_REF}') AS g FROM bd WHERE type = 'text' AND length(t) >= 10),
r1 AS (SELECT doc_id, id, t, m, unnest(range(1, len(m) + 1)) AS i, list_sum([length(x) FOR x IN g[1:i]]) + list_sum([length(x) FOR x IN m[1:i - 1]] || [0]) AS beg FROM r0),
r2 AS (SELECT doc_id, id, m[i] AS x FROM r1 WHERE NOT regexp_matches(substr(t, (greatest(beg - 8, 0) + 1)::INT, (beg - greatest(beg - 8, 0))::INT), '{_CITED}')),
rf AS (SELECT DISTINCT r2.doc_id, r2.id, lb.id AS dst FROM r2 JOIN lb ON r2.doc_id = lb.doc_id AND lb.label = concat({_kind_sql("regexp_extract(x, '^([A-Za-z]+[.]?)', 1)")}, ' ', regexp_extract(x, '([0-9.]+)$', 1))),
e AS (SELECT 'contains' AS type, 1.0 AS confidence, false AS both_ways FROM bd UNION ALL SELECT 'section_next', 1.0, false FROM (SELECT lead(ord) OVER (PARTITION BY doc_id ORDER BY ord) AS x FROM hs) WHERE x IS NOT NULL
UNION ALL SELECT 'caption_of', 1.0, true FROM cp WHERE r = 1 UNION ALL SELECT 'refer_to', 0.9, false FROM rf
UNION ALL SELECT 'reading_next', 1.0, false FROM (SELECT lead(ord) OVER (PARTITION BY doc_id, kept ORDER BY ord) AS x FROM bd WHERE type = 'text') WHERE x IS NOT NULL)
SELECT type, both_ways AS bidirectional, count(*) AS n, round(avg(confidence), 6)::DOUBLE AS confidence FROM e GROUP BY 1, 2""")
def built_graph_edges(spark, sf_dir):
    _, edges = build.build_graph(_elements(spark, sf_dir))
    return edges.groupBy("type", "bidirectional").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("SELECT CAST(doc_id AS STRING) AS doc_id, count(*) AS n_nodes, min(id) AS first, max(id) AS last FROM element GROUP BY 1")
def graph_file_round_trip(spark, sf_dir):
    """Graphs of all documents are written as JSON, a graph a line, and read back."""
    d = source(spark, sf_dir, "element")
    null = F.lit(None)
    nodes = d.select("doc_id", "ord", "id", "type", "page", null.cast("array<int>").alias("section_path"), null.cast("string").alias("section_role"), null.cast("string").alias("label"))
    edges = d.select("doc_id", "ord", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("type"), null.cast("double").alias("confidence"), null.cast("boolean").alias("bidirectional"), null.cast("string").alias("evidence"))
    path = folder(spark)
    files.write_graphs(nodes, edges, path)
    back, _ = files.graph_lines(spark, path)
    return back.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("SELECT CAST(qid AS STRING) AS row_id, metric, round(avg(value), 6) AS value FROM run GROUP BY 1, 2")
def results_csv_round_trip(spark, sf_dir):
    d = source(spark, sf_dir, "run").groupBy(F.col("qid").cast("string").alias("row_id"), "metric").agg(F.round(F.avg("value"), 6).alias("value"))
    path = folder(spark)
    files.write_results(d.select("row_id", F.lit("d").alias("dataset"), F.lit("v").alias("variant"), "metric", "value"), path)
    return files.results(spark, path).select("row_id", "metric", "value")


@query("""SELECT count(*) AS n_lines, count(*) FILTER (event_id % 7 = 0)::BIGINT AS n_malformed, count(*) FILTER (event_id % 7 <> 0 AND event_id % 11 = 0)::BIGINT AS n_blank FROM events""")
def malformed_lines(spark, sf_dir):
    """Lines of which some are cut off and some are blank."""
    path, e = folder(spark), F.col("event_id")
    line = F.when(e % 7 == 0, F.concat(F.lit('{"cut": '), F.col("props"))).when(e % 11 == 0, F.lit("  ")).otherwise(F.col("props"))
    spark.read.parquet(f"{sf_dir}/events.parquet").select(line.alias("value")).write.text(path)
    return files.malformed(spark, path)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """An extension: hourly means by a stream that has read all there is."""
    path = f"{sf_dir}/events.parquet"
    d = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    copy = folder(spark)
    d.write.parquet(copy)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema)
    means = stream.windowed_means(stream.read(spark, copy, schema), late="400 days")
    name = f"means_{uuid.uuid4().hex}"
    q = means.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", folder(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).withColumns({"mean": F.round("mean", 6), "start": F.col("start").cast("timestamp_ntz")})


@query("""WITH v AS (SELECT id, v, unnest(range(16)) AS i, unnest(range(16)) // 4 AS y, unnest(range(16)) % 4 AS x FROM vec)
SELECT id, y // 2 * 2 + x // 2 AS cell, round(avg(v[i + 1]::DOUBLE), 6) AS mean FROM v GROUP BY 1, 2""")
def pooled_patches(spark, sf_dir):
    """A grid of 4 x 4 patches pooled to 2 x 2."""
    d = source(spark, sf_dir, "vec").select("id", F.posexplode(F.slice("v", 1, 16)).alias("i", "x"))
    cell = F.floor(F.col("i") / 4 / 2) * 2 + F.floor(F.col("i") % 4 / 2)
    return d.groupBy("id", cell.cast("long").alias("cell")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("""WITH c AS (SELECT a.id, a.type, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS x FROM edge e JOIN vec a ON e.src = a.id JOIN vec b ON e.dst = b.id WHERE e.type = 'refer_to')
SELECT type, round(avg(x), 6) AS mean, count(*) AS n FROM c GROUP BY type""")
def anchor_cosine(spark, sf_dir):
    from ..functions.vectors import cosine

    n = source(spark, sf_dir, "vec")
    e = source(spark, sf_dir, "edge").filter("type = 'refer_to'").select("src", "dst")
    e = e.join(n.select(F.col("id").alias("src"), "type", F.col("v").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst")
    return e.groupBy("type").agg(F.round(F.avg(cosine(F.col("a"), F.col("b"))), 6).alias("mean"), F.count("*").alias("n"))


@query("""WITH h AS (SELECT doc_id, id, md5('1:' || id) AS h FROM vec)
SELECT doc_id, id, coalesce(lead(id) OVER w, first_value(id) OVER w) AS other FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY h, id)""")
def shifted_pairs(spark, sf_dir):
    """Each vector with the one after it in a seeded order, the last with the first: pairs that mostly do not belong."""
    d = source(spark, sf_dir, "vec").select("doc_id", "id", linking.hash_order(1, "id").alias("h"))
    w = Window.partitionBy("doc_id").orderBy("h", "id")
    first = F.first("id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return d.select("doc_id", "id", F.coalesce(F.lead("id").over(w), first).alias("other"))


@query()
def sphere(spark, sf_dir):
    """Three principal directions of the vectors, as points on a sphere. Signs are free."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from ..functions.vectors import normalise

    d = source(spark, sf_dir, "vec").select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("f"))
    d = PCA(k=3, inputCol="f", outputCol="y").fit(d).transform(d)
    return d.select("id", normalise(vector_to_array("y")).alias("u")).select("id", *[F.get("u", F.lit(i)).alias(k) for i, k in enumerate("xyz")])


@query("""SELECT id, CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024.0, 1)) ELSE printf('%.1f MB', round(n / 1048576.0, 1)) END AS size
FROM (SELECT id, CAST(floor(price) AS BIGINT) * q AS n FROM element)""")
def sizes_as_text(spark, sf_dir):
    return source(spark, sf_dir, "element").select("id", stats.bytes_text(F.floor("price") * F.col("q")).alias("size"))
