"""Writers of elements, evaluations, tables in Markdown and pages of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def write_elements(elements: DataFrame, path: str) -> None:
    """Elements as JSON lines, documents in the order of their ids, elements in theirs; columns that are null are left out."""
    rest = [c for c in elements.columns if c != "ord"]
    d = elements.sort("doc_id", "ord").select(F.to_json(F.struct(*rest)).alias("value"))
    d.write.mode("overwrite").text(path)


def write_evaluation(per_query: DataFrame, path: str, metrics: list[str]) -> None:
    """(dataset, variant, qid, metrics..) as ``perquery``, a query a line, and their means as ``summary``, a variant a line."""
    per_query.select("dataset", "variant", "qid", *metrics).write.mode("overwrite").json(f"{path}/perquery")
    means = per_query.groupBy("dataset", "variant").agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("n_queries"))
    means.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def markdown_table(rows: DataFrame, by: list[str], metrics: list[str], names: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(by.., line): a Markdown line of each row, of percentages with one digit; ``names`` are what values are shown as."""

    def shown(c: str) -> Column:
        out = F.col(c).cast("string")
        for k, v in ((names or {}).get(c) or {}).items():
            out = F.when(F.col(c) == k, v).otherwise(out)
        return out

    cells = [F.coalesce(F.format_string("%.1f", F.round(F.col(m) * 100, 6)), F.lit("-")) for m in metrics]
    return rows.select(*by, F.concat(F.lit("| "), F.concat_ws(" | ", *[shown(c) for c in by], *cells), F.lit(" |")).alias("line"))


def graph_pages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, html): a page for each document that draws its graph without any library.

    ``nodes`` is (doc_id, id, type, label, section_role, text), ``edges`` (doc_id, src, dst, type, confidence, bidirectional,
    evidence). Nodes stand on a circle in the order of their ids; titles tell what they and the edges are. A document's
    graph is one value, as its page is.
    """
    c = F.col
    drawn = nodes.select("doc_id", F.struct(
        "id", "type", text.short_label(c("type"), c("label"), c("text"), c("id")).alias("name"),
        text.node_tooltip(c("id"), c("type"), c("label"), c("section_role"), F.lit(None).cast("string"), c("text")).alias("title")).alias("n"))
    drawn = drawn.groupBy("doc_id").agg(F.sort_array(F.collect_list("n")).alias("nodes"))
    lines = edges.select("doc_id", F.struct("src", "dst", "type", text.edge_tooltip(c("type"), c("confidence"), c("bidirectional"), c("evidence")).alias("title")).alias("e"))
    lines = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    data = F.to_json(F.struct("nodes", F.coalesce("edges", F.array().cast(lines.schema["edges"].dataType)).alias("edges")))
    return drawn.join(lines, "doc_id", "left").select("doc_id", F.concat(F.lit(_HEAD), F.replace(data, F.lit("</"), F.lit("<\\/")), F.lit(_TAIL)).alias("html"))


def write_pages(pages: DataFrame, path: str, buckets: int = 64) -> None:
    """Pages as JSON lines (doc_id, html), compressed, in so many folders by a hash of the document, however many documents there are."""
    d = pages.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    d.repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path, compression="gzip")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, html, nodes, edges) of pages that were written: what they draw is read out of their text."""
    d = spark.read.schema("doc_id string, html string").json(path)
    data = F.from_json(F.substring_index(F.substring_index("html", ";const s=", 1), "const g=", -1), DRAWN)
    return d.select("doc_id", "html", data.alias("g")).select("doc_id", "html", "g.*")


DRAWN = ("struct<nodes: array<struct<id: string, type: string, name: string, title: string>>, "
         "edges: array<struct<src: string, dst: string, type: string, title: string>>>")
_HEAD = "<!doctype html><meta charset=utf-8><svg id=g viewBox='-1.2 -1.2 2.4 2.4' style='width:100%;height:95vh'></svg><script>const g="
_TAIL = (
    ";const s='http://www.w3.org/2000/svg',at={},box=document.getElementById('g');"
    "g.nodes.forEach((n,i)=>{const a=2*Math.PI*i/g.nodes.length;at[n.id]=[Math.cos(a),Math.sin(a)]});"
    "const put=(kind,where,title)=>{const e=document.createElementNS(s,kind);for(const k in where)e.setAttribute(k,where[k]);"
    "const t=document.createElementNS(s,'title');t.textContent=title;e.appendChild(t);box.appendChild(e);return e};"
    "g.edges.forEach(e=>{const a=at[e.src],b=at[e.dst];if(a&&b)put('line',{x1:a[0],y1:a[1],x2:b[0],y2:b[1],stroke:'gray','stroke-width':.002},e.title)});"
    "g.nodes.forEach(n=>{const p=at[n.id];put('circle',{cx:p[0],cy:p[1],r:.012},n.title);"
    "const t=put('text',{x:1.03*p[0],y:1.03*p[1],'font-size':.02},n.title);t.appendChild(document.createTextNode(n.name))});</script>"
)
