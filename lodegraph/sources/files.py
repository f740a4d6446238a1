"""Files of graphs, elements, queries, results and token indexes: readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ELEMENT_ROW, GRAPH_FILE


def graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of JSON files {doc_id: graph}, with places. A missing confidence is 1, a missing flag false.

    Files are whole values, as the format has it; the directory may hold many, which are read side by side.
    """
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", GRAPH_FILE)).alias("doc_id", "g"))
    version = F.coalesce("g.schema_version", F.lit("v1")).alias("schema_version")
    nodes = d.select("doc_id", version, F.posexplode("g.nodes").alias("ord", "n")).select("doc_id", "schema_version", "ord", "n.*")
    edges = d.select("doc_id", F.posexplode("g.edges").alias("ord", "e")).select("doc_id", "ord", "e.*")
    return nodes, edges.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "bidirectional": F.coalesce("bidirectional", F.lit(False))})


def write_graphs(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Graphs as one JSON object {doc_id: graph} a line, in the order of documents; ``graphs`` reads such files split by line."""
    fields = lambda names: F.struct(*names)
    n = nodes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", fields(["id", "type", "page", "section_path", "section_role", "label"]).alias("x")))).alias("nodes"))
    e = edges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", fields(["src", "dst", "type", "confidence", "bidirectional", "evidence"]).alias("x")))).alias("edges"))
    d = n.join(e, "doc_id", "left").select("doc_id", F.transform("nodes", lambda y: y["x"]).alias("nodes"),
                                           F.when(F.col("edges").isNotNull(), F.transform("edges", lambda y: y["x"])).alias("edges"))
    graph = F.struct("doc_id", F.lit("v2.1").alias("schema_version"), "nodes", "edges")
    d = d.sort(F.col("doc_id").cast("string"))  # ranges are found by the ids; graphs become text behind it
    d.select(F.to_json(F.create_map(F.col("doc_id").cast("string"), graph)).alias("value")).write.mode("overwrite").text(path, compression="gzip")  # a file is what a task sorts


def graph_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files with a {doc_id: graph} object in each line, which large files can be split at."""
    d = spark.read.text(path).select(F.explode(F.from_json("value", GRAPH_FILE)).alias("doc_id", "g"))
    nodes = d.select("doc_id", F.posexplode("g.nodes").alias("ord", "n")).select("doc_id", "ord", "n.*")
    edges = d.select("doc_id", F.posexplode("g.edges").alias("ord", "e")).select("doc_id", "ord", "e.*")
    return nodes, edges.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "bidirectional": F.coalesce("bidirectional", F.lit(False))})


def elements(spark: SparkSession, path: str, schema: str = ELEMENT_ROW, only: DataFrame | None = None) -> DataFrame:
    """Elements of JSON lines; lines that are no JSON are left out, and ``only`` keeps some documents."""
    d = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    return d if only is None else d.join(only.select("doc_id"), "doc_id", "left_semi")


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(n_lines, n_malformed, n_blank) of JSON lines."""
    d = spark.read.text(path).withColumn("value", F.translate("value", "\0", ""))
    bad = (F.trim("value") != "") & F.try_parse_json("value").isNull()
    return d.agg(F.count("*").alias("n_lines"), F.count_if(bad).alias("n_malformed"), F.count_if(F.trim("value") == "").alias("n_blank"))


def page_elements(pages: DataFrame) -> DataFrame:
    """Elements out of page records (doc_id, page, elements array), in order; the first text that is not empty counts."""
    d = pages.select("doc_id", "page", F.posexplode("elements").alias("place", "e")).select("doc_id", "page", "place", "e.*")
    have = [F.nullif(c, F.lit("")) for c in ("text", "ocr_text", "vlm_text") if c in d.columns]
    return d.withColumn("text", F.coalesce(*have))


def figure_queries(records: DataFrame) -> DataFrame:
    """(qid, doc_id, query, answer, gt) out of (doc_id, qa array): questions whose reference is not null."""
    d = records.select("doc_id", F.posexplode("qa").alias("i", "q")).filter("q.reference IS NOT NULL")
    return d.select(F.concat("doc_id", F.lit("_q"), F.col("i").cast("string")).alias("qid"), "doc_id", F.col("q.question").alias("query"),
                    F.col("q.answer").alias("answer"), F.array("q.reference").alias("gt"))


def listed(value: Column) -> Column:
    """JSON text of a scalar or a list as a list of strings; null stays null."""
    many = F.from_json(value, "array<string>")
    return F.when(F.ltrim(value).startswith("["), many).when(value.isNotNull(), F.array(F.btrim(value, F.lit('"'))))


def grounded_queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries of JSON lines with ``gt_element_ids`` and ``gt_pages`` or ``evidence_pages``, each a list or one value."""
    d = spark.read.text(path)
    get = lambda k: F.get_json_object("value", f"$.{k}")
    pages = F.coalesce(listed(get("gt_pages")), listed(get("evidence_pages")))
    return d.select(get("qid").alias("qid"), get("doc_id").alias("doc_id"), get("query").alias("query"), get("answer").alias("answer"),
                    F.coalesce(listed(get("gt_element_ids")), F.array().cast("array<string>")).alias("gt"),
                    F.transform(pages, lambda p: p.try_cast("int")).alias("gt_pages"))


def layout(spark: SparkSession, path: str, domains: DataFrame) -> DataFrame:
    """Layout rows of Parquet for the documents of some domains, with their images in base 64."""
    return spark.read.parquet(path).join(domains, "doc_name", "left_semi").withColumn("image_b64", F.base64("image_binary")).drop("image_binary")


def long_results(d: DataFrame) -> DataFrame:
    """(row_id, dataset, variant, metric, value) out of (row_id, results map of maps of maps); counts are left out."""
    d = d.select("row_id", F.explode("results").alias("dataset", "x")).select("row_id", "dataset", F.explode("x").alias("variant", "y"))
    return d.select("row_id", "dataset", "variant", F.explode("y").alias("metric", "value")).filter("metric <> 'n_queries' AND value IS NOT NULL")


def write_tokens(tokens: DataFrame, path: str, buckets: int = 256) -> None:
    """A token index (doc_id, id, tok_ord, vec, valid) as Parquet, in ``buckets`` directories by a hash of the document and
    sorted in each, so that a document's tokens are read without the rest, however many documents there are."""
    d = tokens.withColumn("bucket", token_bucket(F.col("doc_id"), buckets))
    d.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "id", "tok_ord").write.mode("overwrite").partitionBy("bucket").parquet(path)


def token_bucket(doc_id: Column, buckets: int = 256) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(buckets)).cast("int")


def tokens(spark: SparkSession, path: str, doc_id=None, ids: list[str] | None = None) -> DataFrame:
    """The tokens of an index, of one document (its bucket alone is read), or of some elements."""
    d = spark.read.parquet(path)
    if doc_id is not None:
        d = d.filter((F.col("bucket") == token_bucket(F.lit(doc_id))) & (F.col("doc_id") == doc_id))
    if ids is not None:
        d = d.filter(F.col("id").isin(*ids))
    return d.drop("bucket")


def write_results(long: DataFrame, path: str) -> None:
    long.write.mode("overwrite").option("header", True).csv(path)


def results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row_id string, dataset string, variant string, metric string, value double").csv(path, header=True)
